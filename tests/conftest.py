from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from broadsheet.session import build_session, checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression over one row of named text columns."""

    def run(column, **values):
        schema = ", ".join(f"{name} string" for name in values) or "x string"
        row = tuple(values.values()) or ("",)
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return run
