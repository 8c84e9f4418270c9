"""Corpus pipeline over ``documents``: STAGES, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of ``docs``. Rows with a null id or text
go through every stage (nothing can be held against them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import bpe, common, decontam, jaccard, pii, toxicity

#: No SQL: the toxicity and personal-data stages are trained models.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier scores below its threshold."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return common.keep_rows(docs, "text", lambda: lambda texts: (model.scores(texts) < toxicity.THRESHOLD).tolist(), 4 << 20)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of linked documents; repeated rows of one id stay once."""
    found = common.stored(jaccard.groups(docs), "groups")
    own = F.coalesce(F.bool_or(F.col("doc_id") == F.col("component_id")), F.lit(False))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), own.alias("kept"))
    ids = common.stored(ids.where("rows > 1 or not kept"), "ids")
    # the copies' ids, fewer than the others', go to the texts
    copies = ids.where("not kept").select("doc_id")
    copies = F.broadcast(copies) if copies.count() <= jaccard.BROADCAST_ROWS else copies
    kept = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti").select(docs.columns)
    if not ids.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not."""
    found = decontam.contaminated(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))
    return docs.join(common.stored(found.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return pii.mask(docs, pii.train(pii.sample_windows(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document that is left, with the digest of what they decode to."""
    return bpe.digests(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
