"""Plan-shape guard: no registered query plans a cartesian product, a nested-loop
join or a Python UDF (checked on the formatted physical plan)."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as E
from gridbill.plans import catalog

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n != "ingest_readings_stream"))
def test_plan_has_no_forbidden_operators(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, SF).explain("formatted")
    plan = buf.getvalue()
    assert "== Physical Plan ==" in plan
    assert not [op for op in FORBIDDEN if op in plan]
