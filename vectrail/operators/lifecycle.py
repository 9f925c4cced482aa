"""Life of single tracks from the frames in which each was observed: states, hits,
misses and confidence per frame, by gaps and islands.

A track starts tentative. The observation that makes ``min_hits`` hits, or
any that comes after the track was confirmed once, leaves it confirmed; a miss
makes a confirmed track lost, and removes it when it is tentative or has missed over
``max_age`` frames. What is observed under the same keys after a removal begins
another life.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.operators.motion import memory

MIN_HITS, MAX_AGE, SCORES = 3, 30, 32


def lives(observations: DataFrame, keys: tuple[str, ...] = ("stream_id", "track"), min_hits: int = MIN_HITS, max_age: int = MAX_AGE) -> DataFrame:
    """``observations`` (one row a track and frame) with ``life`` (from 1), ``hits`` and
    ``born``, the first frame of the life.

    Runs of frames are islands. A tentative track dies at its first miss, so a life
    outlives its first run only if that has hits enough, and goes on for all runs
    that follow without a gap over ``max_age``; shorter runs before such
    a run are lives of their own."""
    need = max(min_hits, 2)  # the observation that begins a track confirms nothing
    w = W.partitionBy(*keys).orderBy("frame_number")
    gap = F.col("frame_number") - F.lag("frame_number").over(w) - 1
    rows = observations.where("frame_number is not null").withColumn("__gap", gap)
    rows = rows.withColumn("__starts", F.coalesce(F.col("__gap") >= 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("__run", F.sum("__starts").over(w)).withColumn("__stretch", F.sum(F.coalesce(F.col("__gap") > max_age, F.lit(True)).cast("int")).over(w))
    rows = rows.withColumn("__long", F.count("*").over(W.partitionBy(*keys, "__stretch", "__run")) >= need)
    rows = rows.withColumn("__first", F.min(F.when(F.col("__long"), F.col("__run"))).over(W.partitionBy(*keys, "__stretch")))
    joins = F.coalesce(F.col("__run") > F.col("__first"), F.lit(False))
    rows = rows.withColumn("life", F.sum(F.when(joins, 0).otherwise(F.col("__starts"))).over(w))
    of_life = W.partitionBy(*keys, "life").orderBy("frame_number")
    return rows.withColumn("hits", F.row_number().over(of_life).cast("bigint")).withColumn("born", F.first("frame_number").over(of_life)).drop("__gap", "__starts", "__run", "__stretch", "__long", "__first")


def states(observations: DataFrame, keys: tuple[str, ...] = ("stream_id", "track"), min_hits: int = MIN_HITS, max_age: int = MAX_AGE, delta: int = 3) -> DataFrame:
    """A row for every frame of every life, up to the one that removes it: ``keys``, ``life,
    frame_number, state, hits, missed, age, remembered`` (observations that are kept)."""
    need = max(min_hits, 2)
    rows = lives(observations.select(*keys, "frame_number").distinct(), keys, min_hits, max_age)
    following = F.lead("frame_number").over(W.partitionBy(*keys).orderBy("frame_number"))
    kept = F.count("*").over(W.partitionBy(*keys, "life").orderBy("frame_number").rangeBetween(-memory(delta), 0))
    rows = rows.withColumn("following", following).withColumn("remembered", kept).withColumn("firm", F.col("hits") >= need)
    # misses until the next observation, no more than it takes to be removed
    end = F.when(F.col("firm"), max_age + 1).otherwise(1)
    missed = F.least(F.coalesce(F.col("following") - F.col("frame_number") - 1, end), end)
    each = rows.withColumn("missed", F.explode(F.sequence(F.lit(0).cast("bigint"), missed.cast("bigint"))))
    state = F.when(F.col("missed") == 0, F.when(F.col("firm"), "confirmed").otherwise("tentative")).when(F.col("missed") == end, "removed").otherwise("lost")
    frame = F.col("frame_number") + F.col("missed")
    return each.select(*keys, "life", frame.alias("frame_number"), state.alias("state"), "hits", "missed", (frame - F.col("born")).alias("age"), "remembered")


def confidence(mean_score: Column, hits: Column, missed: Column, min_hits: int = MIN_HITS, max_age: int = MAX_AGE) -> Column:
    """0..1, of recent scores, hits and the frames since the last one."""
    c = 0.5 * mean_score + 0.2 * F.least(hits / max(min_hits, 1), F.lit(1.0)) + 0.3 * F.greatest(1 - missed / max(max_age, 1), F.lit(0.0))
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def scored(observations: DataFrame, keys: tuple[str, ...] = ("stream_id", "track"), min_hits: int = MIN_HITS, max_age: int = MAX_AGE) -> DataFrame:
    """``observations`` (with ``score``) with ``life``, ``hits``, ``mean_score`` of a life's last
    ``SCORES`` observations and ``confidence``."""
    w = W.partitionBy(*keys, "life").orderBy("frame_number").rowsBetween(1 - SCORES, 0)
    rows = lives(observations, keys, min_hits, max_age).withColumn("mean_score", F.avg("score").over(w))
    return rows.withColumn("confidence", confidence(F.col("mean_score"), F.col("hits"), F.lit(0), min_hits, max_age))
