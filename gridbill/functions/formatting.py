"""Display formatting and parsing as JVM column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_n(c: Column | str, decimals: int = 0) -> Column:
    """en-US grouped number with ``decimals`` places, rounding half away from zero.

    ``format_number`` alone rounds half-even (2.5 -> "2"); rounding first gives
    the SQL Server FORMAT(x,'N0') / JS toFixed result (2.5 -> "3").
    """
    return F.format_number(F.round(_c(c), decimals), decimals)


def quantity_text(value: Column | str, unit: Column | str) -> Column:
    """FORMAT(x,'N0') + ' ' + Unit; NULL when either side is NULL (string + is NULL-propagating)."""
    return F.concat(format_n(value, 0), F.lit(" "), _c(unit))


def parse_quantity(text: Column | str) -> Column:
    """Numeric part of "1,299 kWh": all commas removed (not just the first), NULL if unparsable."""
    number = F.split_part(_c(text), F.lit(" "), F.lit(1))
    return F.regexp_replace(number, ",", "").try_cast("decimal(20,2)")


def quantity_unit(text: Column | str) -> Column:
    return F.split_part(_c(text), F.lit(" "), F.lit(2))


def month_label(c: Column | str) -> Column:
    """FORMAT(d, 'MMMM yyyy') -> "November 2025"."""
    return F.date_format(_c(c), "MMMM yyyy")


def day_label(c: Column | str) -> Column:
    """FORMAT(d, 'yyyy-MM-dd')."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def rupees(c: Column | str) -> Column:
    """"Rs. 1234.50": two decimals, no grouping (JS toFixed(2))."""
    return F.concat(F.lit("Rs. "), F.round(_c(c), 2).cast("decimal(20,2)").cast("string"))
