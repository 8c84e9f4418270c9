"""Sinks: report export (S3) and snapshot writes.

Writes are distributed (one file per task, no single-file coalesce), and a
snapshot is never written over the path it was read from.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.validate import ERRORS, tag_errors

VALID = "Valid"


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists",
           partition_by: list[str] | None = None) -> None:
    """S3: write a report; CSV gets a header row. The reference's "Export as CSV"
    link is dead, so the layout (one folder of part files) is ours."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_snapshot(df: DataFrame, new_path: str, source_path: str | None = None,
                   fmt: str = "parquet") -> None:
    """Write a maintenance snapshot to a new location (refuses the source path)."""
    if source_path is not None and new_path.rstrip("/") == source_path.rstrip("/"):
        raise ValueError("a snapshot must not overwrite the path it was read from")
    df.write.mode("errorifexists").format(fmt).save(new_path)


def export_observed(df: DataFrame, path: str, figures: Mapping[str, Column], fmt: str = "csv",
                    partition_by: list[str] | None = None) -> dict:
    """Write a report and return aggregates over its rows (totals, counts) from the same pass.

    The figures are taken where the rows are written, in the job's last stage, whose tasks count once even
    if they run again; so an exported report is not computed a second time for its total.
    """
    seen = Observation()
    export(df.observe(seen, *[c.alias(n) for n, c in figures.items()]), path, fmt, partition_by=partition_by)
    return seen.get


def write_checked(df: DataFrame, rules: Mapping[str, Column], path: str) -> dict[str, int]:
    """P7/P8 in one pass: rows are written to ``Valid=true`` and ``Valid=false`` with their ``Errors``; the
    rows breaking each rule, and all rows (under ``rows``), are counted on the way."""
    tagged = tag_errors(df, rules).withColumn(VALID, F.size(ERRORS) == 0)
    broken = {f"r{i}": F.count(F.when(F.array_contains(ERRORS, name), 1)) for i, name in enumerate(rules)}
    counts = export_observed(tagged, path, {"rows": F.count(F.lit(1)), **broken}, "parquet", [VALID])
    return {"rows": counts["rows"], **{name: counts[f"r{i}"] for i, name in enumerate(rules)}}
