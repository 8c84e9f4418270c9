from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def tiny() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture()
def documents(spark: SparkSession):
    """Rows (doc_id, text) as a table with extra columns whose names operators use inside."""

    def make(rows):
        wide = [(i, t, "x", 1, b"y", 2) for i, t in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, key string, n int, ids binary, label int")

    return make
