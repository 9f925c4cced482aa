"""Run reports: stage timings, rates, and time that no stage accounts for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_report(calls: DataFrame) -> DataFrame:
    """``calls(stage, duration_ms, items)`` by stage, the costliest first; no
    items count as one. Percentiles are exact and linear."""
    p = F.percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    g = calls.groupBy("stage").agg(F.count("*").alias("calls"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms"), p.alias("p"), F.max("duration_ms").alias("max_ms"))
    out = g.select("stage", "calls", "items", "total_ms", "mean_ms", *[F.col("p")[k].alias(n) for k, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))], "max_ms", (F.col("total_ms") / F.greatest("items", F.lit(1))).alias("ms_per_item"))
    return out.orderBy(F.desc("total_ms"), "stage")


def run_report(calls: DataFrame, frames: int, elapsed_ms: float) -> DataFrame:
    """One row: rates, and the elapsed time that stages account for or not."""
    accounted = F.coalesce(F.sum("duration_ms"), F.lit(0.0))
    return calls.agg(accounted.alias("accounted_ms")).select(
        F.lit(frames).cast("bigint").alias("frames"),
        F.lit(float(elapsed_ms)).alias("elapsed_ms"),
        F.lit(1000.0 * frames / elapsed_ms if elapsed_ms > 0 else 0.0).alias("fps"),
        F.lit(elapsed_ms / frames if frames else 0.0).alias("ms_per_frame"),
        "accounted_ms",
        F.greatest(F.lit(float(elapsed_ms)) - F.col("accounted_ms"), F.lit(0.0)).alias("unaccounted_ms"),
    )


def combined_rate(detectors: DataFrame) -> DataFrame:
    """``detectors(detector, total_ms, frames)`` run one after the other: their
    costs a frame add up. Those without frames cost nothing."""
    cost = F.sum(F.when(F.col("frames") > 0, F.col("total_ms") / F.col("frames")))
    return detectors.agg(F.when(cost > 0, 1000 / cost).otherwise(0.0).alias("combined_fps"))
