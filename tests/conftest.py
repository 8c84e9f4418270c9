from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridbill import schemas  # noqa: E402
from gridbill.session import local_session  # noqa: E402
from gridbill.sources import testdata  # noqa: E402
from gridbill.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("GRIDBILL_SCRATCH", tempfile.mkdtemp(prefix="gridbill-test-"))
    s = local_session("*", 8, app="gridbill-tests")
    yield s


def frame(spark, entity: str, rows: list[dict]):
    """A literal entity frame; unspecified columns are NULL."""
    schema = schemas.ENTITY_SCHEMAS[entity]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture
def tables(spark):
    """Build a Tables bundle from literal rows; utility types and tariffs default to the fixtures."""

    def build(**entities):
        frames = {"utility_type": testdata.utility_type(spark), "tariff": testdata.tariff(spark)}
        for e in schemas.ENTITY_SCHEMAS:
            if e in entities:
                v = entities[e]
                frames[e] = v if hasattr(v, "schema") else frame(spark, e, v)
            elif e not in frames:
                frames[e] = frame(spark, e, [])
        return Tables.from_frames(spark, **frames)

    return build
