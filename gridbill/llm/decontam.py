"""Benchmark decontamination by template canonicalisation (operator 9), in DataFrame functions only.

Words become templates: numbers, units and names (capitalised words) turn into
typed placeholders, all other words are lower-cased. Windows of ``WIDTH`` template
words are hash-joined with those of the benchmark's items. Along each alignment of
an item with a document, the placeholders' values must map one-to-one (the same
name to the same name, different ones to different ones): so a question with other
numbers and names is caught, and a chance run of like-typed words is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common

WIDTH = 8
#: Words of a window that must not be placeholders; with fewer, the placeholders' values must be equal too.
LITERALS = 4
#: Consecutive windows of an item that make a quote of it (11 words).
RUN = 4
#: Share of an item's windows that a document must hold where it holds no such run (short items, items with many edits).
SHARE = 0.5
#: Benchmark windows up to this number are broadcast (24 bytes each and their slots); more are joined by a shuffle.
BROADCAST_ROWS = 500_000

# Marks stripped off words, and units of measure.
MARKS = ".,;:!?\"'()[]{}|*#$%&<>=~`^_/\\-+“”‘’«»…–—¿¡"
UNITS = "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz kb mb gb tb w kw mw v volt volts usd eur gbp dollar dollars euro euros cent cents percent degree degrees kph mph".split()
_SPACES = "\t\n\x0b\f\r"
_NUMBER = "^[0-9]+([.,:/-][0-9]+)*$"
_NAME = "^\\p{Lu}[\\p{Ll}'’-]+$"


def words(text: Column) -> Column:
    """The text's words without marks at their ends; a null text has none."""
    blank = F.translate(F.coalesce(text, F.lit("")), _SPACES, " " * len(_SPACES))
    return F.filter(F.transform(F.split(blank, " "), lambda w: F.btrim(w, F.lit(MARKS))), lambda w: w != "")


def _template(word: Column) -> Column:
    """The word's hash, or 1, 2, 3 for a number, unit or name."""
    low = F.lower(word)
    kind = (
        F.when((word >= "0") & (word < ":") & word.rlike(_NUMBER), 1)
        .when(low.isin(UNITS), 2)
        .when(((word < "a") | (word > "z")) & word.rlike(_NAME), 3)
    )  # fmt: skip  # the comparisons only spare most words the pattern
    return F.coalesce(kind.cast("long"), F.xxhash64(low))


def _templates(words: Column) -> Column:
    """h: the words' templates; s: the hash of each placeholder's value, else 0. A word's kind is found once."""
    value = lambda w, h: F.when((h >= 1) & (h <= 3), F.xxhash64(w)).otherwise(F.lit(0).cast("long"))
    return common.bound(words, lambda ws: common.bound(F.transform(ws, _template), lambda hs: F.struct(hs.alias("h"), F.zip_with(ws, hs, value).alias("s"))))


def windows(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, pos, window, literals, slots): every run of ``width`` template words of each whole text."""
    def runs(own: Column) -> Column:
        one = lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.slice(own["h"], i, width)).alias("window"), F.filter(F.slice(own["s"], i, width), lambda x: x != 0).alias("slots")
        )
        return F.when(F.size(own["h"]) >= width, F.transform(F.sequence(F.lit(1), F.size(own["h"]) - (width - 1)), one))

    return df.select(id_col, F.inline(common.bound(_templates(words(F.col(text_col))), runs))).withColumn("literals", width - F.size("slots"))


def _has_run(places: Column) -> Column:
    """Whether sorted distinct places hold ``RUN`` consecutive ones."""
    last = F.size(places) - (RUN - 1)
    ends = lambda i: F.element_at(places, i + F.lit(RUN - 1)) - F.element_at(places, i) == RUN - 1
    return F.when(last >= 1, F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), ends)).otherwise(F.lit(False))


def _hits(documents: DataFrame, benchmark: DataFrame, width: int, literals: int) -> DataFrame:
    """(doc_id, item_id, matched, enough, run): windows of one width that are in document and item along consistent alignments.

    ``matched`` counts windows of at least ``literals`` words that are no placeholders, and
    literally equal windows where the document has no others of the item; ``enough`` tells
    whether they are the share of the item's windows (of the literal ones if it has no others).
    """
    typed = F.col("literals") >= literals
    keyed = lambda df: df.withColumn("window", F.when(typed, F.col("window")).otherwise(F.xxhash64("window", "slots")))
    items = keyed(windows(benchmark, "item_id", "text", width))
    share = lambda of: F.ceil(F.countDistinct(F.when(of, F.col("pos"))) * F.lit(SHARE))
    need = items.groupBy("item_id").agg(F.struct(share(typed).alias("typed"), share(~typed).alias("literal")).alias("need"))
    items = items.join(need, "item_id").select("item_id", "need", "window", typed.alias("typed"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    if items.count() <= BROADCAST_ROWS:
        items = F.broadcast(items)
    met = keyed(windows(documents, "doc_id", "text", width)).join(items, "window")
    lined = met.groupBy("doc_id", "item_id", "need", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        # at most one window for each place of the item: bounded by the item's length
        F.collect_set(F.struct("item_pos", "typed", (F.col("item_slots") == F.col("slots")).alias("equal"), F.arrays_zip("item_slots", "slots").alias("pairs"))).alias("met")
    )
    pairs = F.array_distinct(F.flatten("met.pairs"))
    one_to_one = lambda p: (F.size(p) == F.size(F.array_distinct(p["item_slots"]))) & (F.size(p) == F.size(F.array_distinct(p["slots"])))
    others = lambda p, x: F.filter(p, lambda y: (y["item_slots"] == x["item_slots"]) | (y["slots"] == x["slots"]))
    clash = common.bound(pairs, lambda p: F.when(one_to_one(p), F.slice(p, 1, 0)).otherwise(F.filter(p, lambda x: F.size(others(p, x)) > 1)))
    held = common.bound(clash, lambda c: F.filter("met", lambda w: w["equal"] | ~F.arrays_overlap(w["pairs"], c)))
    at = lambda which: F.size(F.array_distinct(F.filter("held", which)["item_pos"]))
    counted = lined.select("doc_id", "item_id", "need", held.alias("held")).select(
        "doc_id", "item_id", "need", at(lambda w: w["typed"]).alias("n_typed"), at(lambda w: ~w["typed"]).alias("n_literal"),
        _has_run(F.array_sort(F.array_distinct("held.item_pos"))).alias("run"),
    )
    summed = counted.groupBy("doc_id", "item_id", "need").agg(F.sum("n_typed").alias("n_typed"), F.sum("n_literal").alias("n_literal"), F.max("run").alias("run"))
    enough = F.when(F.col("need.typed") > 0, F.col("n_typed") >= F.col("need.typed")).otherwise(F.col("n_literal") >= F.col("need.literal"))
    return summed.select("doc_id", "item_id", F.when(F.col("n_typed") > 0, F.col("n_typed")).otherwise(F.col("n_literal")).alias("matched"), enough.alias("enough"), "run")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows): documents that hold ``RUN`` consecutive windows of a benchmark item, or ``SHARE`` of its windows.

    Items shorter than a window are one window of their own length, literal unless at
    least half of its words (two at least) are no placeholders; an item of one word
    matches nothing. Null texts have no words; rows with a null id are left out;
    repeated rows of one id count as one document.
    """
    documents = documents.select("doc_id", "text").where("doc_id is not null")
    items = benchmark.select("item_id", "text").where("item_id is not null")
    size = F.size(words(F.col("text")))
    short = sorted(r[0] for r in items.select(size.alias("n")).where((F.col("n") >= 2) & (F.col("n") < WIDTH)).distinct().collect())
    found = _hits(documents, items, WIDTH, LITERALS)
    for n in short:  # at most WIDTH - 2 lengths
        found = found.unionByName(_hits(documents, items.where(size == n), n, max(2, -(-n // 2))))
    return found.where("run or enough").select("doc_id", "item_id", F.col("matched").cast("long").alias("n_windows"))


def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item that it holds, with the number of windows."""
    return contaminated(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    words_of = lambda table, key: f"""
  SELECT {key}, list_filter(list_transform(string_split_regex(coalesce(text, ''), {_quoted("[ \\t\\n\\x0B\\f\\r]+")}), lambda w: trim(w, {_quoted(MARKS)})), lambda w: w <> '') AS w
  FROM {table} WHERE {key} IS NOT NULL"""  # noqa: E731
    kind = f"""CASE WHEN regexp_matches(w, {_quoted(_NUMBER)}) THEN 1 WHEN list_contains([{", ".join(map(_quoted, UNITS))}], lower(w)) THEN 2
      WHEN regexp_matches(w, {_quoted(_NAME)}) THEN 3 ELSE 0 END"""
    runs = lambda source, key: f"""
  SELECT {key}, i AS pos, array_to_string(list_transform(w[i : i + n - 1], lambda w: CASE {kind} WHEN 0 THEN lower(w) ELSE chr(1) || ({kind})::VARCHAR END), chr(31)) AS win,
    list_filter(w[i : i + n - 1], lambda w: {kind} <> 0) AS slots, n
  FROM (SELECT {key}, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {source} CROSS JOIN (SELECT unnest(range(2, {WIDTH + 1})) AS n) lengths WHERE len(w) >= n
    AND (n = {WIDTH} OR n IN (SELECT len(w) FROM bw)) AND ({_quoted(source)} = 'dw' OR n = {WIDTH} OR len(w) = n)) e"""  # noqa: E731
    typed = f"n - len(slots) >= CASE n WHEN {WIDTH} THEN {LITERALS} ELSE greatest(2, ceil(n / 2)) END"
    zipped = "list_transform(range(1, len(bs) + 1), lambda k: {'b': bs[k], 'd': ds[k]})"
    line = "doc_id, item_id, n, shift"
    return f"""
WITH dw AS ({words_of("documents", "doc_id")}
), bw AS ({words_of("benchmark", "item_id")}
), d AS ({runs("dw", "doc_id")}
), b AS (SELECT *, {typed} AS typed FROM ({runs("bw", "item_id")})
), need AS (
  SELECT item_id, n, ceil(count(DISTINCT pos) FILTER (typed) * {SHARE}) AS typed, ceil(count(DISTINCT pos) FILTER (NOT typed) * {SHARE}) AS literal FROM b GROUP BY ALL
), met AS (
  SELECT DISTINCT d.doc_id, b.item_id, b.n, d.pos - b.pos AS shift, b.pos, b.typed, b.slots AS bs, d.slots AS ds
  FROM d JOIN b ON d.win = b.win AND d.n = b.n WHERE b.typed OR b.slots = d.slots
), pairs AS (
  SELECT DISTINCT {line}, x.b, x.d FROM (SELECT {line}, unnest({zipped}) AS x FROM met)
), clash AS (
  SELECT {line}, list({{'b': b, 'd': d}}) AS c
  FROM (SELECT *, count(*) OVER (PARTITION BY {line}, b) AS ds_of_b, count(*) OVER (PARTITION BY {line}, d) AS bs_of_d FROM pairs)
  WHERE ds_of_b > 1 OR bs_of_d > 1 GROUP BY ALL
), held AS (
  SELECT DISTINCT {line}, pos, typed FROM met LEFT JOIN clash USING ({line}) WHERE bs = ds OR c IS NULL OR NOT list_has_any({zipped}, c)
), placed AS (
  SELECT *, pos - lag(pos, {RUN - 1}) OVER (PARTITION BY {line} ORDER BY pos) = {RUN - 1} AS run FROM held
), found AS (
  SELECT doc_id, item_id, n, count(*) FILTER (typed) AS n_typed, count(*) FILTER (NOT typed) AS n_literal, coalesce(bool_or(run), FALSE) AS run FROM placed GROUP BY ALL
)
SELECT doc_id, item_id, (CASE WHEN n_typed > 0 THEN n_typed ELSE n_literal END)::BIGINT AS n_windows
FROM found JOIN need USING (item_id, n)
WHERE run OR CASE WHEN need.typed > 0 THEN n_typed >= need.typed ELSE n_literal >= need.literal END
"""


ORACLE = _sql()
