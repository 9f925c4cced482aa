"""Frame tables: range, stride and limit sampling, strict checks, and exact timing reports."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.operators.order import numbered


def strict(frames: DataFrame, allow_missing_dts: bool = True) -> DataFrame:
    """Fails on a frame without a presentation timestamp and, unless allowed,
    on one without a decoding timestamp. Timestamps are never made up."""
    missing = F.col("pts").isNull()
    if not allow_missing_dts:
        missing = missing | F.col("dts").isNull()
    where = F.concat(F.lit("no timestamp: stream "), F.col("stream_id").cast("string"), F.lit(", packet "), F.col("packet_index").cast("string"))
    return frames.withColumn("pts", F.when(missing, F.raise_error(F.coalesce(where, F.lit("no timestamp"))).cast("bigint")).otherwise(F.col("pts")))


def increasing(frames: DataFrame, order: str = "packet_index") -> DataFrame:
    """Fails unless timestamps strictly increase in every stream, as a writer needs."""
    before = F.lag("pts").over(W.partitionBy("stream_id").orderBy(order))
    where = F.concat(F.lit("timestamps do not increase: stream "), F.col("stream_id").cast("string"), F.lit(", pts "), F.col("pts").cast("string"))
    return frames.withColumn("__before", before).withColumn("pts", F.when(F.col("pts") <= F.col("__before"), F.raise_error(where).cast("bigint")).otherwise(F.col("pts"))).drop("__before")


def counts(frames: DataFrame, emitted: DataFrame) -> DataFrame:
    """Per stream: rows decoded, without a timestamp, out of order, and emitted."""
    last = F.last("pts", ignorenulls=True).over(W.partitionBy("stream_id").orderBy("packet_index").rowsBetween(W.unboundedPreceding, -1))
    n = frames.withColumn("__last", last).groupBy("stream_id").agg(F.count("*").alias("n_decoded"), F.count_if(F.col("pts").isNull()).alias("n_dropped"), F.count_if(F.col("pts") <= F.col("__last")).alias("n_out_of_order"))
    return n.join(emitted.groupBy("stream_id").agg(F.count("*").alias("n_emitted")), "stream_id", "left").withColumn("n_emitted", F.coalesce("n_emitted", F.lit(0).cast("bigint")))


def trajectory(tracks: DataFrame, length: int = 64) -> DataFrame:
    """For each row of ``(track, frame_number, cx, cy)`` the last ``length`` centres, its own included."""
    w = W.partitionBy("track").orderBy("frame_number").rowsBetween(-(length - 1), 0)
    return tracks.withColumn("path", F.collect_list(F.struct("cx", "cy")).over(w))


#: Steps of the variable schedule, in ticks of 1/90000 s; they repeat.
TICKS = 90_000
VARIABLE_STEPS = [3000, 3000, 3000, 6000, 11250, 11250, 6000, 3000]


def schedule(spark: SparkSession, mode: str, duration: float = 4.0, gap: float = 2.5) -> DataFrame:
    """``(frame_number, pts)`` of a made-up clip up to the first frame at or after
    its end: 'cfr' at 25 frames a second, 'vfr' with repeating steps, 'gap' like
    it, with one step of ``gap`` seconds at half time."""
    if mode not in ("cfr", "vfr", "gap"):
        raise ValueError(f"no such mode: {mode}")
    steps = [TICKS // 25] if mode == "cfr" else VARIABLE_STEPS
    starts = [sum(steps[:k]) for k in range(len(steps))]
    plain = lambda n: n // len(steps) * sum(steps) + starts[n % len(steps)]
    first = lambda ticks: next(n for n in itertools.count(len(steps) * max(0, ticks // sum(steps))) if plain(n) >= ticks)
    end = int(duration * TICKS)
    middle = first(end // 2)
    shift = int(gap * TICKS) - steps[middle % len(steps)] if mode == "gap" else 0
    n = F.col("id")
    pts = F.floor(n / len(steps)).cast("bigint") * sum(steps) + F.get(F.array(*map(F.lit, starts)), (n % len(steps)).cast("int"))
    rows = spark.range(max(middle + 1, first(max(0, end - shift))) + 1 if shift else first(end) + 1)
    return rows.select(n.alias("frame_number"), (pts + F.when(n > middle, shift).otherwise(0)).cast("bigint").alias("pts"))


def sample(frames: DataFrame, stride: int = 1, max_frames: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Null timestamps go, then the range [start, end] in ticks, then every
    ``stride``-th frame of a stream, then the first ``max_frames``. Adds the
    gapless ``frame_number``. Frames are numbered by ranges, so a long stream is not one task."""
    kept = frames.where("pts is not null")
    if start is not None:
        kept = kept.where(F.col("pts") >= start)
    if end is not None:
        kept = kept.where(F.col("pts") <= end)
    kept = numbered(kept, "stream_id", ["pts", "packet_index"], "__n").where(F.col("__n") % stride == 0).withColumn("frame_number", F.floor(F.col("__n") / stride).cast("bigint")).drop("__n")
    return kept if max_frames is None else kept.where(F.col("frame_number") < max_frames)


def out_of_order(frames: DataFrame) -> DataFrame:
    """Frames whose timestamp does not exceed that of the frame that arrived before."""
    before = F.lag("pts").over(W.partitionBy("stream_id").orderBy("packet_index"))
    return frames.withColumn("previous", before).where("pts <= previous")


def timing_report(frames: DataFrame, tick: float = 1e-6) -> DataFrame:
    """Per stream: frames, span, and the distribution of the steps between frames."""
    step = F.col("pts") - F.lag("pts").over(W.partitionBy("stream_id").orderBy("pts", "packet_index"))
    g = frames.where("pts is not null").withColumn("d", step).groupBy("stream_id").agg(F.count("*").alias("n_frames"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"), F.countDistinct("d").alias("n_steps"), F.min("d").alias("min_step"), F.max("d").alias("max_step"), F.avg("d").alias("mean_step"), F.stddev_pop("d").alias("std_step"))
    fps = F.when(F.col("mean_step") > 0, 1 / (F.col("mean_step") * tick)).otherwise(0.0)
    return g.select("stream_id", "n_frames", "first_pts", "last_pts", (F.col("last_pts") - F.col("first_pts")).alias("span"), "n_steps", "min_step", "max_step", F.round("mean_step", 4).alias("mean_step"), F.round("std_step", 4).alias("std_step"), (F.col("n_steps") > 1).alias("is_vfr"), F.round(fps, 6).alias("fps"))
