"""Decisions on tracks while they grow.

A track is decided when it has ``min_samples`` samples, then after every
``every`` more. At each point the samples retained there are fused, searched
and decided; the last decision stands, also where it takes back an earlier one.
A track that is ready at its end and has no decision gets one in a final pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.functions.vectors import dot, let, unit_or_null
from vectrail.operators import fusion, gallery
from vectrail.operators.fusion import MAX_SAMPLES, MIN_SAMPLES
from vectrail.sources.shared import stored

EVERY = 5
#: Points of a track that are gathered together where all samples count.
POINTS = 20


def _summed(xs: Column, term) -> Column:
    """The sum over samples of the vectors that ``term`` gives."""
    zero = F.transform(F.get(xs, F.lit(0))["vector"], lambda x: F.lit(0.0))
    return F.aggregate(xs, zero, lambda acc, x: F.zip_with(acc, term(x), lambda a, b: a + b))


def _weighted(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["weight"])
    mean = lambda s, n: F.transform(s, lambda x: x / n)
    weighted = let(total, lambda w: mean(_summed(xs, lambda x: F.transform(x["vector"], lambda y: y * x["weight"])), w))
    return F.when(total >= 1e-8, weighted).otherwise(mean(_summed(xs, lambda x: x["vector"]), F.size(xs)))


def _median(xs: Column) -> Column:
    n = F.size(xs)

    def middle(dim):
        return let(F.sort_array(F.transform(xs, lambda x: F.get(x["vector"], dim))), lambda v: (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)

    return F.transform(F.sequence(F.lit(0), F.size(F.get(xs, F.lit(0))["vector"]) - 1), middle)


def _moving(xs: Column) -> Column:
    first = F.get(xs, F.lit(0))["vector"]

    def step(acc, x):
        a = F.least(0.3 * x["weight"], F.lit(1.0))
        return F.zip_with(acc, x["vector"], lambda old, new: (1 - a) * old + a * new)

    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), first, step)


FUSED = {"weighted_mean": _weighted, "median": _median, "ema": _moving}


def _coherence(xs: Column) -> Column:
    """Mean cosine over pairs of unit vectors, from their sum."""
    n = F.size(xs)
    squares = F.aggregate(xs, F.lit(0.0), lambda s, x: s + dot(x["vector"], x["vector"]))
    pairs = let(_summed(xs, lambda x: x["vector"]), lambda s: (dot(s, s) - squares) / (n * (n - 1)))
    return F.when(n < 2, F.lit(1.0)).otherwise(pairs)


def _point(xs: Column, n: Column, strategy: str, renormalise: bool) -> Column:
    """What is known at a point from the samples retained there."""
    vector = unit_or_null(FUSED[strategy](xs), renormalise=renormalise)
    weight = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["weight"]) / F.size(xs)
    last = F.element_at(xs, -1)["seq"]
    return F.struct(n.alias("seen"), F.size(xs).alias("n_samples"), last.alias("seq"), vector.alias("vector"), weight.alias("mean_weight"), _coherence(xs).alias("coherence"))


SAMPLE = ("seq", "weight", "vector")


def growing(samples: DataFrame, strategy: str = "weighted_mean", min_samples: int = MIN_SAMPLES, every: int = EVERY, max_samples: int = MAX_SAMPLES, renormalise: bool = True, count_all: bool = False) -> DataFrame:
    """``samples(track, seq, weight, vector)`` to one row per track and point: ``track, seen,
    n_samples, seq, vector, mean_weight, coherence``.

    The schedule counts the retained samples, so it ends when these no longer grow
    (with 3, 5 and 32: after 28); a point whose fused vector vanishes is tried
    again at the next sample. Only a track's first ``max_samples`` samples
    matter then, and they are gathered once. With ``count_all`` the schedule counts
    all samples and does not end; a point whose vector vanishes is left out, samples
    are gathered in parts of ``POINTS`` points, each with those retained before it."""
    kept = samples.select("track", F.col("seq").cast("bigint").alias("seq"), F.col("weight").cast("double").alias("weight"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    n = F.row_number().over(W.partitionBy("track").orderBy("seq"))
    gathered = F.array_sort(F.collect_list(F.struct(*SAMPLE))).alias("xs")
    if not count_all:
        tracks = kept.withColumn("n", n).where(F.col("n") <= max_samples).groupBy("track").agg(gathered).where(F.size("xs") >= min_samples)

        def attempt(found: Column, k: Column) -> Column:
            due = (F.size(found) == 0) | (k - F.element_at(F.concat(F.array(F.lit(0)), F.transform(found, lambda p: p["seen"])), -1) >= every)
            new = let(_point(F.slice("xs", 1, k), k, strategy, renormalise), lambda p: F.when(p["vector"].isNotNull(), F.concat(found, F.array(p))).otherwise(found))
            return F.when(due, new).otherwise(found)

        none = F.slice(F.array(_point(F.col("xs"), F.lit(0), strategy, renormalise)), 1, 0)
        points = F.aggregate(F.sequence(F.lit(min_samples), F.size("xs")), none, attempt)
    else:
        if strategy == "ema":
            raise ValueError("a moving average has no part that it forgets: it cannot be gathered in parts")
        span = every * POINTS
        # samples n serve the points from n to n + max_samples - 1
        part = lambda k: F.floor((k - min_samples) / span)
        rows = kept.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.greatest(part(F.col("n")), F.lit(0)), F.greatest(part(F.col("n") + (max_samples - 1)), F.lit(0)))))
        tracks = rows.groupBy("track", "part").agg(gathered, F.min("n").alias("low"), F.max("n").alias("high"))
        begin, last = min_samples + F.col("part") * span, F.least("high", min_samples + (F.col("part") + 1) * span - 1)
        tracks = tracks.where(last >= begin)
        at = F.sequence(begin, last, F.lit(every).cast("bigint"))

        def of(k: Column) -> Column:
            first = F.greatest(k - max_samples + 1, F.col("low"))
            return _point(F.slice("xs", (first - F.col("low") + 1).cast("int"), (k - first + 1).cast("int")), k.cast("int"), strategy, renormalise)

        points = F.filter(F.transform(at, of), lambda p: p["vector"].isNotNull())
    return tracks.select("track", F.explode(points).alias("p")).select("track", "p.*")


def decided(samples: DataFrame, entries: DataFrame, threshold: float | Column, margin: float = gallery.MARGIN, floor: float = gallery.FLOOR, k: int = gallery.TOP_K, strategy: str = "weighted_mean", min_samples: int = MIN_SAMPLES, max_samples: int = MAX_SAMPLES, **schedule) -> DataFrame:
    """Every decision on every track: ``track, seen, n_samples, seq, finalised, coherence,
    mean_weight, identity, similarity, margin, reason, accepted, candidates``. All points of
    all tracks are searched in one pass. Decisions of the final pass have no ``seq``."""
    points = growing(samples, strategy, min_samples=min_samples, max_samples=max_samples, **schedule)
    points = stored(points.withColumn("finalised", F.lit(False)), "points")
    late = samples.join(points.select("track").distinct(), "track", "left_anti")
    last = fusion.fuse(late, strategy, min_samples, max_samples).join(fusion.coherence(late).select("track", "coherence"), "track")
    size = F.col("n_samples").cast("int")
    last = last.select("track", size.alias("seen"), size.alias("n_samples"), F.lit(None).cast("bigint").alias("seq"), "vector", "mean_weight", "coherence", F.lit(True).alias("finalised"))
    # numbered once and written, so that a search and what is joined to it agree
    every = stored(points.unionByName(last).withColumn("query_id", F.monotonically_increasing_id()), "numbered")
    found = gallery.identify(every.select("query_id", "vector", "coherence"), entries, threshold, margin, floor, k)
    return every.drop("vector", "coherence").join(found, "query_id").select("track", "seen", "n_samples", "seq", "finalised", "coherence", "mean_weight", "identity", "similarity", "margin", "reason", "accepted", "candidates")


def standing(decisions: DataFrame) -> DataFrame:
    """The last decision of each track."""
    columns = [c for c in decisions.columns if c != "track"]
    return decisions.groupBy("track").agg(F.max_by(F.struct(*columns), F.struct("finalised", "seen")).alias("d")).select("track", "d.*")
