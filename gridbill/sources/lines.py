"""Line files that may hold broken lines.

``DataFrameReader`` in its permissive mode leaves NULL where a value does not fit the
declared type, and what it notices depends on the columns a query asks for. Here the raw
line is kept beside the typed row, every line gets an outcome, and no value is lost or
rounded unseen: a line is accepted as it was written or refused with a reason and its text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.validate import ERRORS, tag_errors

LINE, OUTCOME = "Line", "Outcome"
_BROKEN = "_broken"
_EXACT = "decimal(38,18)"


def _changed(field: T.StructField, said: Column, typed: Column) -> Column:
    """Whether the text of a value is there and its typed form is not, or is another number."""
    lost = typed.isNull()
    if isinstance(field.dataType, T.DecimalType):
        lost = lost | ~said.try_cast(_EXACT).eqNullSafe(typed.cast(_EXACT))
    return said.isNotNull() & lost


def read_lines(spark: SparkSession, entity: str, path: str, fmt: str = "json",
               rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Every line of the text files under ``path``: the entity's columns, ``Line`` and ``Outcome``.

    ``fmt``: ``json`` (one object a line, columns by name, others ignored) or ``csv`` (the declared columns in
    their order; a line that is their names is a header). Blank lines are no rows. The
    outcome is ``broken line`` (no object, cut off, or another number of values), else
    ``bad <column>`` for the first value that its type cannot hold exactly, else the
    first of ``rules`` (see ``validate``) that the row breaks, else ``accepted``. One pass, no shuffle;
    a line is parsed twice, as values and as their texts, whatever is asked of the result.
    """
    fields = schemas.ENTITY_SCHEMAS[entity].fields
    names = [f.name for f in fields]
    loose = [T.StructField(f.name, f.dataType, True) for f in fields]
    broken = T.StructField(_BROKEN, T.StringType(), True)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    lines = spark.read.text(path).select(F.col("value").alias(LINE)).where(F.trim(LINE) != "")
    texts = T.StructType([*(T.StructField(n, T.StringType(), True) for n in names), broken])
    if fmt == "json":
        typed, said = F.from_json(LINE, T.StructType([*loose, broken]), options), F.from_json(LINE, texts, options)
    elif fmt == "csv":
        lines = lines.where(F.col(LINE) != ",".join(names))
        ddl = lambda s: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s)
        typed, said = F.from_csv(LINE, ddl([*loose, broken]), options), F.from_csv(LINE, ddl(texts), options)
    else:
        raise ValueError(f"line files are json or csv, not {fmt}")
    # A generated row: its parsed structs are columns that a filter on the outcome reads; over a
    # projection the filter would be pushed down and parse the line anew for each mention of a value.
    both = lines.select(LINE, F.inline(F.array(F.struct(typed.alias("_typed"), said.alias("_said")))))
    whole = F.col("_said").isNotNull() & F.col("_said")[_BROKEN].isNull()
    bad = F.coalesce(*[F.when(_changed(f, F.col("_said")[f.name], F.col("_typed")[f.name]), F.lit(f"bad {f.name}")) for f in fields])
    unfit = F.coalesce(F.when(~whole, F.lit("broken line")), bad, F.when(F.col("_typed")[_BROKEN].isNotNull(), F.lit("broken line")))
    rows = both.select(*[F.col("_typed")[n].alias(n) for n in names], LINE, unfit.alias("_unfit"))
    first = F.try_element_at(F.col(ERRORS), F.lit(1))
    return tag_errors(rows, rules or {}).select(*names, LINE, F.coalesce("_unfit", first, F.lit("accepted")).alias(OUTCOME)) if rules else (
        rows.select(*names, LINE, F.coalesce("_unfit", F.lit("accepted")).alias(OUTCOME)))
