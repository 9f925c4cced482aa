"""Counters of the engine's own stages, gathered while a table passes.

A stage is wrapped with the counters it should have; they fill when an action reads the
table, in the same pass. A table that is read twice counts once: the first action that
ends decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "stage string, counter string, value double"


class Counters:
    """Counters by stage, in the order in which stages were wrapped."""

    def __init__(self):
        self.stages: list[tuple[str, Observation, list[str]]] = []

    def watch(self, df: DataFrame, stage: str, **counters: Column) -> DataFrame:
        """``df``, with counters over its rows: aggregates by name. ``rows`` is always there."""
        if any(stage == name for name, *_ in self.stages):
            raise ValueError(f"stage {stage} is watched already")
        seen = Observation(f"{stage}-{id(self)}-{len(self.stages)}")
        every = {"rows": F.count(F.lit(1))} | counters
        self.stages.append((stage, seen, list(every)))
        return df.observe(seen, *[c.alias(n) for n, c in every.items()])

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(stage, counter, value)``. Waits for the action of each stage, so one must have been started."""
        found = []
        for stage, seen, names in self.stages:
            got = seen.get
            found += [(stage, n, None if got[n] is None else float(got[n])) for n in names]
        return spark.createDataFrame(found, SCHEMA)


def fusion_statistics(samples: DataFrame, min_samples: int = 3, max_samples: int = 32) -> DataFrame:
    """One row ``tracks, ready, retained_samples, total_seen``: how full the buffers of all tracks are."""
    n = samples.groupBy("track").agg(F.count("*").alias("n"))
    kept = F.least("n", F.lit(max_samples))
    return n.agg(F.count("*").alias("tracks"), F.count_if(kept >= min_samples).alias("ready"), F.coalesce(F.sum(kept), F.lit(0)).cast("bigint").alias("retained_samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_seen"))
