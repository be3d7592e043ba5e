from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from broadsheet.llm.batches import importable

SF_DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with columns whose names the operators use themselves."""
    importable(spark)

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if clash:
            names = ("row", "row_key", "words", "n_words", "kept", "spans", "node", "rep", "label", "shard", "slot", "doc", "tag", "start", "end", "bucket", "ids", "minima")
            df = df.withColumns({name: F.lit("clash") for name in names})
        return df

    return make


@pytest.fixture(scope="session")
def words():
    """Seeded invented words and texts."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]

    def text(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(pool) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def sf_docs(spark):
    if not SF_DIR.exists():
        pytest.skip("driver tables are not there")
    importable(spark)
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


EDGE_ROWS = [(1, None), (2, ""), (3, " \n\t "), (None, "some words without an id"), (5, "one"), (6, "same same"), (6, "same same"), (7, "É ü 漢字  x\x00y"), (8, "word " * 30_000)]
