"""ST1: field readings as a stream.

The reference accepts one reading per POST. Here submissions arrive as files
in a folder; a Structured Streaming query validates each micro-batch (required
fields, known meter), and ``foreachBatch`` writes accepted readings and refused
rows to two Parquet tables, partitioned by epoch.

``foreachBatch`` is at-least-once: after a failure a micro-batch can run again.
Each epoch overwrites its own partition of either table, so a replayed batch
leaves both as they were, and every submission is kept, equal ones too. An epoch
hands out ReadingIDs from a range of its own (epoch and row number), so nothing
stored is scanned and ids never meet.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from ..operators.maintain import OUTCOME, append_readings
from ..schemas import METER_READING
from ..session import output_dir

# A field submission: what the reading form posts.
SUBMISSION = T.StructType([
    T.StructField("MeterID", T.StringType(), True),
    T.StructField("UserID", T.StringType(), True),
    T.StructField("ReadingValue", T.StringType(), True),
    T.StructField("ReadingDate", T.StringType(), True),
    T.StructField("Notes", T.StringType(), True),
])


@dataclass
class IngestPaths:
    readings: str
    rejected: str
    checkpoint: str

    @classmethod
    def under(cls, base: str) -> "IngestPaths":
        base = base.rstrip("/")
        return cls(f"{base}/readings", f"{base}/rejected", f"{base}/_checkpoint")

    @classmethod
    def fresh(cls, spark: SparkSession) -> "IngestPaths":
        """A new folder beside the session's shared checkpoint directory."""
        return cls.under(f"{output_dir(spark)}/ingest-{uuid.uuid4().hex}")


#: ReadingIDs of an epoch: (epoch + 1) * EPOCH_IDS + row number; ids below EPOCH_IDS are left to other writers.
EPOCH_IDS = 1 << 40
EPOCH = "Epoch"


def accepted_readings(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    """The readings that the ingest has stored (no path: none were)."""
    return _table(spark, paths.readings, METER_READING).select(*METER_READING.fieldNames())


def refused_submissions(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    """The refused submissions with their outcome and epoch."""
    return _table(spark, paths.rejected, REFUSED)


REFUSED = T.StructType([*METER_READING.fields, T.StructField(OUTCOME, T.StringType(), True)])


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(EPOCH, T.LongType(), True)])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def batch_writer(meters: DataFrame, paths: IngestPaths):
    """The ``foreachBatch`` function: validate, number, overwrite the epoch's partitions."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        subs = batch.select(
            "MeterID", "UserID",
            F.col("ReadingValue").try_cast("decimal(10,2)").alias("ReadingValue"),
            F.col("ReadingDate").try_cast("date").alias("ReadingDate"),
            "Notes")
        result = append_readings(subs, meters, (epoch_id + 1) * EPOCH_IDS)
        ok = result.where(F.col(OUTCOME) == "accepted").drop(OUTCOME)
        no = result.where(F.col(OUTCOME) != "accepted")
        for rows, path in ((ok, paths.readings), (no, paths.rejected)):
            # the epoch's own folder, replaced as a whole, also when it has no rows
            rows.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch_id}")

    return write


def ingest_readings_stream(stream: DataFrame, meters: DataFrame, paths: IngestPaths,
                           available_now: bool = True):
    """Start the ingest query over a streaming frame of submissions (SUBMISSION
    columns, values as text). Returns the StreamingQuery."""
    w = (stream.writeStream.foreachBatch(batch_writer(meters, paths))
         .option("checkpointLocation", paths.checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _bounded(reader: DataStreamReader, max_files: int | None, max_bytes: str | None) -> DataStreamReader:
    for name, value in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader


def submissions_from_files(spark: SparkSession, folder: str, fmt: str = "json",
                           max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """Submissions dropped as files (json / csv / parquet) into ``folder``; ``max_files`` or
    ``max_bytes`` bounds a micro-batch (the first one may otherwise be the whole backlog)."""
    r = _bounded(spark.readStream.schema(SUBMISSION).format(fmt), max_files, max_bytes)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.load(folder)


EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("props", T.StringType(), True),
])


def submissions_from_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet",
                            max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """The test data's event log read as a stream of reading submissions: one
    submission per event, the event value being the register value sent. The
    file source watches ``folder`` for files matching ``pattern``."""
    ev = _bounded(spark.readStream.schema(EVENTS), max_files, max_bytes).option("pathGlobFilter", pattern).parquet(folder)
    return ev.select(
        F.concat(F.lit("MTR-"), F.col("user_id").cast("string")).alias("MeterID"),
        F.concat(F.lit("U-00"), (F.col("event_id") % 5 + 1).cast("string")).alias("UserID"),
        F.col("value").cast("decimal(10,2)").cast("string").alias("ReadingValue"),
        F.col("ts").cast("date").cast("string").alias("ReadingDate"),
        F.when(F.col("event_type") == "error", F.lit("error")).alias("Notes"))
