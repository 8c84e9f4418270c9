"""The display fallbacks the reference applies in the browser, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """JS ``x || y`` treats '' as missing."""
    return F.nullif(_c(c), F.lit(""))


def fallback(c: Column | str, other: Column | str) -> Column:
    return F.coalesce(blank_to_null(c), _c(other))


def or_text(c: Column | str, text: str) -> Column:
    return F.coalesce(blank_to_null(_c(c).cast("string")), F.lit(text))


def status_slug(c: Column | str) -> Column:
    """lower-case, first space to hyphen ("Pending Install" -> "pending-install")."""
    return F.regexp_replace(F.lower(_c(c)), "^([^ ]*) ", "$1-")


def slab_label(min_units: Column | str, max_units: Column | str) -> Column:
    """"min - max", with a missing or zero max shown as "Above"."""
    mx = F.when(_c(max_units).isNull() | (_c(max_units) == 0), F.lit("Above")).otherwise(
        _c(max_units).cast("string"))
    return F.concat(_c(min_units).cast("string"), F.lit(" - "), mx)
