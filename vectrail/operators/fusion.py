"""Fusing the vectors of a track: weighted mean, moving average, median."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.functions.vectors import let, unit_or_null

MAX_SAMPLES, MIN_SAMPLES = 32, 3


def retained(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """The last ``max_samples`` samples of each track."""
    last = F.row_number().over(W.partitionBy("track").orderBy(F.desc("seq")))
    return samples.withColumn("__n", last).where(F.col("__n") <= max_samples).drop("__n")


def per_dimension(samples: DataFrame) -> DataFrame:
    return samples.select("track", "seq", "weight", F.posexplode("vector").alias("dim", "x"))


def collected(dims: DataFrame, renormalise: bool = True) -> DataFrame:
    """(track, dim, x) as one vector a track, of length one unless told otherwise;
    null where it vanishes."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return dims.groupBy("track").agg(v.alias("v")).select("track", unit_or_null(F.col("v"), renormalise=renormalise).alias("vector"))


def weighted_mean(samples: DataFrame, max_samples: int = MAX_SAMPLES, renormalise: bool = True) -> DataFrame:
    """Partial sums per dimension; plain mean where the weights vanish."""
    w = F.sum("weight")
    x = F.when(w >= 1e-8, F.sum(F.col("x") * F.col("weight")) / F.greatest(w, F.lit(1e-300))).otherwise(F.avg("x"))
    return collected(per_dimension(retained(samples, max_samples)).groupBy("track", "dim").agg(x.alias("x")), renormalise)


def median(samples: DataFrame, max_samples: int = MAX_SAMPLES, renormalise: bool = True) -> DataFrame:
    """Of each component. A track's few retained vectors are gathered once, and
    sorted component by component."""
    rows = retained(samples, max_samples).groupBy("track").agg(F.collect_list("vector").alias("vs"))
    n = F.size("vs")
    at = lambda xs, k: F.get(xs, F.floor(k).cast("int"))

    def middle(dim):
        return let(F.sort_array(F.transform("vs", lambda v: F.get(v, dim))), lambda xs: (at(xs, (n - 1) / 2) + at(xs, n / 2)) / 2)

    v = F.transform(F.sequence(F.lit(0), F.size(F.get("vs", F.lit(0))) - 1), middle)
    return rows.select("track", unit_or_null(v, renormalise=renormalise).alias("vector"))


def moving_average(samples: DataFrame, alpha: float = 0.3, renormalise: bool = True) -> DataFrame:
    """An exponential average over all samples in order; each one's share is
    alpha times its weight. Closed form: a sample counts with its share times
    all later samples' remainders, so the sum needs no order within a group. A
    share of one starts the average again: what came before counts nothing."""
    order = W.partitionBy("track").orderBy("seq")
    later = order.rowsBetween(1, W.unboundedFollowing)
    first = F.row_number().over(order) == 1
    a = F.least(F.lit(alpha) * F.col("weight"), F.lit(1.0))
    rest = F.exp(F.coalesce(F.sum(F.when(a < 1, F.log(1 - a))).over(later), F.lit(0.0)))
    rest = F.when(F.coalesce(F.max(a >= 1).over(later), F.lit(False)), 0.0).otherwise(rest)
    share = samples.withColumn("weight", F.when(first, rest).otherwise(a * rest))
    return collected(per_dimension(share).groupBy("track", "dim").agg(F.sum(F.col("x") * F.col("weight")).alias("x")), renormalise)


STRATEGIES = {"weighted_mean": weighted_mean, "median": median, "ema": moving_average}


def fuse(samples: DataFrame, strategy: str = "weighted_mean", min_samples: int = MIN_SAMPLES, max_samples: int = MAX_SAMPLES, renormalise: bool = True, **options) -> DataFrame:
    """``(track, vector, n_samples, mean_weight)`` of the tracks that are ready:
    with at least ``min_samples`` retained samples and a fused vector that does
    not vanish. ``renormalise`` makes the vector's length one."""
    kept = retained(samples, max_samples)
    n = kept.groupBy("track").agg(F.count("*").alias("n_samples"), F.avg("weight").alias("mean_weight")).where(F.col("n_samples") >= min_samples)
    ready = samples.join(n.select("track"), "track", "left_semi")
    if strategy == "ema":  # has seen all samples
        fused = moving_average(ready, renormalise=renormalise, **options)
    else:
        fused = STRATEGIES[strategy](ready, max_samples=max_samples, renormalise=renormalise, **options)
    return fused.where("vector is not null").join(n, "track").select("track", "vector", "n_samples", "mean_weight")


def ready_tracks(samples: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    return samples.groupBy("track").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("track")


def coherence(samples: DataFrame) -> DataFrame:
    """Mean cosine over the pairs of a track's retained unit vectors, without
    forming pairs: (|sum|^2 - sum of |v|^2) / (n (n - 1))."""
    kept = retained(samples)
    total = per_dimension(kept).groupBy("track", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    both = total.groupBy("track").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"))
    n = kept.groupBy("track").agg(F.count("*").alias("n_samples"), F.avg("weight").alias("mean_weight"))
    c = F.when(F.col("n_samples") < 2, 1.0).otherwise((F.col("s2") - F.col("q")) / F.greatest(F.col("n_samples") * (F.col("n_samples") - 1), F.lit(1)))
    return n.join(both, "track").select("track", "n_samples", "mean_weight", c.alias("coherence"))


def decision_points(samples: DataFrame, min_samples: int = MIN_SAMPLES, every: int = 5, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Samples at which a track is decided: at ``min_samples``, then after
    every ``every`` more, while the retained count still grows."""
    n = F.row_number().over(W.partitionBy("track").orderBy("seq"))
    return samples.withColumn("n_samples", n).where((F.col("n_samples") >= min_samples) & (F.col("n_samples") <= max_samples) & ((F.col("n_samples") - min_samples) % every == 0))
