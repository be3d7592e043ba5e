"""Registered queries against their SQL, and the pipeline against its stages' brute-force versions."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from broadsheet.llm.queries import ORACLE, QUERIES
from tests.llm import test_decontaminate, test_near

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are not there")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, oracle, name):
    df, want = QUERIES[name](spark, str(SF_DIR)), oracle.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert ordered(df.columns, df.collect()) == ordered(want.columns, want.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, oracle):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, None
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near dedup", "benchmark decontamination", "secret scan", "byte-level BPE"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, str(SF_DIR)).cache()
        after = {r.doc_id for r in docs.collect()}
        if name != "byte-level BPE":
            assert docs.columns == columns
        if name == "near dedup":
            assert after == {i for i, (_, _, first) in test_near.brute(before).items() if first}
        elif name == "benchmark decontamination":
            items = oracle.sql("SELECT item_id, text FROM benchmark").fetchall()
            assert after == {row[0] for row in test_decontaminate.brute(before, items) if not row[-1]}
        elif name != "quality rules":
            assert after == {i for i, _ in before}
        kept = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(SF_DIR)).collect()} == kept
