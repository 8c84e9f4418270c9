"""Clock and date-range helpers.

The reference reads the wall clock (GETDATE()) inside its reports; here every
such operator takes an explicit ``as_of`` so results are reproducible. Ranges
are whole days and half-open (``>= start AND < end + 1 day``) so that a
timestamp on the last day is never dropped, and so that both bounds reach the
Parquet scan as pushed filters (MONTH()/YEAR() predicates do not push down).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = dt.date | dt.datetime | str

DEFAULT_START = dt.date(1900, 1, 1)
DEFAULT_END = dt.date(2099, 12, 31)


def to_date(v: DateLike | None, default: dt.date | None = None) -> dt.date | None:
    if v is None or v == "":
        return default
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(str(v)[:10])


def to_datetime(v: DateLike) -> dt.datetime:
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    return dt.datetime.fromisoformat(str(v))


def month_start(as_of: DateLike) -> dt.date:
    d = to_date(as_of)
    return d.replace(day=1)


def add_months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.month - 1 + n, 12)
    return d.replace(year=d.year + y, month=m + 1, day=1)


def day_range(col: Column | str, start: DateLike | None, end: DateLike | None) -> Column:
    """Whole days ``start``..``end`` inclusive, as a half-open range on ``col``.

    Works for date and timestamp columns; missing bounds take the reference's
    defaults 1900-01-01 and 2099-12-31.
    """
    c = F.col(col) if isinstance(col, str) else col
    s = to_date(start, DEFAULT_START)
    e = to_date(end, DEFAULT_END) + dt.timedelta(days=1)
    return (c >= F.lit(s)) & (c < F.lit(e))


def in_month(col: Column | str, as_of: DateLike) -> Column:
    """Same calendar month as ``as_of`` (MONTH(x)=MONTH(now) AND YEAR(x)=YEAR(now))."""
    c = F.col(col) if isinstance(col, str) else col
    s = month_start(as_of)
    return (c >= F.lit(s)) & (c < F.lit(add_months(s, 1)))


def last_n_days(col: Column | str, as_of: DateLike, days: int) -> Column:
    """``as_of - days < col <= as_of`` on a day-valued column (trap T5)."""
    c = F.col(col) if isinstance(col, str) else col
    d = to_date(as_of)
    return (c > F.lit(d - dt.timedelta(days=days))) & (c <= F.lit(d))


def months_back_start(as_of: DateLike, months: int) -> dt.date:
    """First day of the month ``months`` before ``as_of``'s month (T4: spans months+1 months)."""
    return add_months(month_start(as_of), -months)
