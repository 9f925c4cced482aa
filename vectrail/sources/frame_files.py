"""Frames in files by time, so that a range is read without what lies before it.

``write`` puts frames in folders by slots of time, within them in order of stream and
time, and beside them a table of the key frames. ``seek`` starts each stream at its last
key frame at or before the target, as decoding must; ``sample`` reads the
range alone. Folders outside the range are not listed, and row groups of other streams
and times are skipped by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.operators import frames as operators

#: Ticks of a slot: ten minutes in microseconds.
SLOT = 600_000_000


def write(frames: DataFrame, path: str, slot: int = SLOT) -> None:
    """Frames without a timestamp have no place in time; they are not written."""
    timed = frames.where("pts is not null").withColumn("slot", F.floor(F.col("pts") / slot).cast("bigint"))
    order = ["slot", "stream_id", "pts", "packet_index"]
    timed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("slot").parquet(f"{path}/frames")
    keys = frames.where("pts is not null and key_frame").select("stream_id", "pts", F.lit(slot).cast("bigint").alias("slot_ticks"))
    keys.repartitionByRange("stream_id", "pts").sortWithinPartitions("stream_id", "pts").write.mode("overwrite").parquet(f"{path}/keys")


def _within(rows: DataFrame, ticks: int, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        rows = rows.where((F.col("slot") >= start // ticks) & (F.col("pts") >= start))
    if end is not None:
        rows = rows.where((F.col("slot") <= end // ticks) & (F.col("pts") <= end))
    return rows


def _opened(spark: SparkSession, path: str, streams: list | None) -> tuple[DataFrame, DataFrame]:
    frames, keys = spark.read.parquet(f"{path}/frames"), spark.read.parquet(f"{path}/keys")
    if streams is not None:
        frames, keys = (x.where(F.col("stream_id").isin(streams)) for x in (frames, keys))
    return frames, keys


def _slot(spark: SparkSession, path: str, default: int) -> int:
    one = spark.read.parquet(f"{path}/keys").select("slot_ticks").first()
    return one[0] if one else default


def seek(spark: SparkSession, path: str, target: int, end: int | None = None, streams: list | None = None, slot: int = SLOT) -> DataFrame:
    """Frames of each stream from its last key frame at or before ``target``, up to ``end``, with
    ``wanted``: those from the target on. A stream without such a key frame is read from its
    start, and none is skipped for it. ``slot`` matters only where there is no key frame at all."""
    ticks = _slot(spark, path, slot)
    frames, keys = _opened(spark, path, streams)
    since = keys.where(F.col("pts") <= target).groupBy("stream_id").agg(F.max("pts").alias("since"))
    # streams with frames before the target but no key frame there
    late = frames.where(F.col("slot") <= target // ticks).where(F.col("pts") < target).select("stream_id").distinct().join(since, "stream_id", "left_anti")
    earliest = None
    if late.isEmpty():
        low = since.agg(F.min("since")).first()[0]  # one number
        earliest = target if low is None else min(low, target)
    rows = _within(frames, ticks, earliest, end).join(since, "stream_id", "left")
    rows = rows.where(F.col("since").isNull() | (F.col("pts") >= F.col("since")))
    return rows.withColumn("wanted", F.col("pts") >= target).drop("since", "slot")


def sample(spark: SparkSession, path: str, stride: int = 1, max_frames: int | None = None, start: int | None = None, end: int | None = None, streams: list | None = None, slot: int = SLOT) -> DataFrame:
    """``frames.sample`` of the written frames, reading the range's slots only."""
    frames, _ = _opened(spark, path, streams)
    return operators.sample(_within(frames, _slot(spark, path, slot), start, end).drop("slot"), stride, max_frames, start, end)
