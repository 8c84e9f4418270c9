"""Consumption of each reading as it arrives, with keyed streaming state (ST1 with W2 and B1).

The reference looks a reading's predecessor up when somebody asks for it. Here a
stateful stream keeps, per meter, the readings that are not older than the
watermark and the last one before them. Each reading is answered on arrival with its previous value and
consumption. One that arrives late, between two answered readings, is answered too, and the
reading after it is answered again (a correction). The last answer of a reading is therefore
what ``reading_consumption`` gives over all readings that have arrived.

A reading older than all that its meter's state still holds cannot be placed any more; it is
answered ``too late`` and changes nothing. A meter's state grows with the readings within the watermark's
delay, not with its history. The sink has one folder per epoch, which a replayed epoch replaces.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rating import CONSUMPTION
from ..schemas import METER_READING, MONEY
from .ingest import EPOCH

ANSWERED, CORRECTED, TOO_LATE, REPEATED = "answered", "corrected", "too late", "repeated"
#: What a meter's state holds: its readings in order (days since 1970, ids, hundredths) and whether older ones were let go.
STATE = "days array<int>, ids array<bigint>, hundredths array<bigint>, cut boolean"
ANSWER = "MeterID string, ReadingID bigint, day int, hundredths bigint, previous bigint, Outcome string"
DAY_MS = 86_400_000


@dataclass
class Paths:
    answers: str
    checkpoint: str

    @classmethod
    def under(cls, base: str) -> "Paths":
        return cls(f"{base.rstrip('/')}/answers", f"{base.rstrip('/')}/_checkpoint")


def placed(held: list[tuple], cut: bool, new: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Readings (day, id, hundredths) put among those a meter holds: all of them in order, and the answers (id, day,
    hundredths, previous, outcome). The first reading of a meter has a previous value of 0; a NULL value stays NULL."""
    known, answers, fresh = {h[1] for h in held}, [], set()
    for r in new:
        if r[1] in known:
            answers.append((*r[1::-1], r[2], None, REPEATED))
        elif cut and held and r[:2] < held[0][:2]:
            answers.append((*r[1::-1], r[2], None, TOO_LATE))
        else:
            known.add(r[1])
            fresh.add(r[1])
    every = sorted([*held, *(r for r in {r[1]: r for r in new}.values() if r[1] in fresh)], key=lambda r: r[:2])
    for i, (day, own, value) in enumerate(every):
        after_new = i > 0 and every[i - 1][1] in fresh
        if own in fresh or after_new:
            answers.append((own, day, value, every[i - 1][2] if i else 0, ANSWERED if own in fresh else CORRECTED))
    return every, answers


def kept(every: list[tuple], horizon: int) -> list[tuple]:
    """The readings not older than the horizon (a day) and the last one before it."""
    older = sum(r[0] < horizon for r in every)
    return every[max(0, older - 1) :]


def answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The stateful function of one meter and micro-batch."""
    days, ids, values, cut = state.get if state.exists else ([], [], [], False)
    none = lambda v: None if pd.isna(v) else int(v)
    new = [(int(r.day), int(r.ReadingID), none(r.hundredths)) for f in frames for r in f.itertuples()]
    every, answers = placed(list(zip(days, ids, values)), cut, new)
    left = kept(every, state.getCurrentWatermarkMs() // DAY_MS)
    state.update(([r[0] for r in left], [r[1] for r in left], [r[2] for r in left], bool(cut or len(left) < len(every))))
    out = pd.DataFrame(answers, columns=["ReadingID", "day", "hundredths", "previous", "Outcome"], dtype=object)
    out.insert(0, "MeterID", key[0])
    yield out.astype({"ReadingID": "int64", "day": "int32", "hundredths": "Int64", "previous": "Int64"})


def consumption_stream(readings: DataFrame, paths: Paths, delay: str = "62 days"):
    """Start the query over a streaming frame of readings (ReadingID, MeterID, ReadingDate, ReadingValue). Returns the
    StreamingQuery, which ends when all that is there has been read. Readings without a meter, id or date take no part
    (an ingest refuses them). ``delay``: how late a reading may come after the newest one and still be placed."""
    rows = (readings.where("MeterID IS NOT NULL AND ReadingDate IS NOT NULL AND ReadingID IS NOT NULL")
            .select("MeterID", "ReadingID", F.unix_date("ReadingDate").alias("day"), F.col("ReadingDate").cast("timestamp").alias("_at"),
                    (F.col("ReadingValue").cast(MONEY) * 100).cast("bigint").alias("hundredths"))
            .withWatermark("_at", delay))
    answers = rows.groupBy("MeterID").applyInPandasWithState(answer, ANSWER, STATE, "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{paths.answers}/{EPOCH}={epoch}")

    return (answers.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", paths.checkpoint)
            .trigger(availableNow=True).start())


def readings_from_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stored readings as a stream of files; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(METER_READING)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder)


def all_answers(spark: SparkSession, paths: Paths) -> DataFrame:
    """Every answer with its epoch: MeterID, ReadingID, ReadingDate, Current/PreviousReadingValue, Consumption, Outcome."""
    money = lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast(MONEY)
    a = spark.read.schema(f"{ANSWER}, {EPOCH} bigint").parquet(paths.answers)
    return a.select("MeterID", "ReadingID", F.date_from_unix_date("day").alias("ReadingDate"), money("hundredths").alias("CurrentReadingValue"),
                    money("previous").alias("PreviousReadingValue"),
                    ((F.col("hundredths") - F.col("previous")).cast("decimal(20,0)") / 100).cast(CONSUMPTION).alias("Consumption"), "Outcome", EPOCH)


def latest_answers(spark: SparkSession, paths: Paths) -> DataFrame:
    """The last answer of each reading that was placed, as one aggregate."""
    a = all_answers(spark, paths).where(F.col("Outcome").isin(ANSWERED, CORRECTED))
    said = F.struct("MeterID", "ReadingDate", "CurrentReadingValue", "PreviousReadingValue", "Consumption")
    return a.groupBy("ReadingID").agg(F.max_by(said, EPOCH).alias("a")).select("ReadingID", "a.*")
