"""Detections: filters, pairs within a frame, suppression, and what stays unpaired.

Rows are keyed by ``FRAME``; rows with a null there belong to no frame and take
no part in pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.functions.geometry import Box, box, clamp, containment, iou, overlap
from vectrail.operators import assign

FRAME = ["stream_id", "frame_number"]
HIGH, LOW = 0.35, 0.10
MIN_BODY_AREA, MIN_FACE_SIDE = 512.0, 24.0
MAX_DETECTIONS = 300
MAX_ROLL = 45.0


def large_enough(b: Box, min_area: float = MIN_BODY_AREA, min_side: float = 0.0) -> Column:
    """Positive extents, and at least this area and shorter side."""
    return b.valid & (b.area >= min_area) & (F.least(b.width, b.height) >= min_side)


def face_large_enough(b: Box, min_side: float = MIN_FACE_SIDE) -> Column:
    return large_enough(b, 0.0, min_side)


def has_landmarks(points: list[Column]) -> Column:
    """Every coordinate is there."""
    return F.coalesce(F.size(F.array_compact(F.array(*points))) == len(points), F.lit(False))


def bounded_score(score: Column) -> Column:
    """Within 0..1, as half-precision models overshoot."""
    return clamp(score)


def band(score: Column, high: float = HIGH, low: float = LOW) -> Column:
    """'high', 'low', or null for what is dropped."""
    return F.when(score >= high, "high").when(score >= low, "low")


def upright(roll: Column, limit: float | None = MAX_ROLL) -> Column:
    """Not rolled by more than the limit; none without one."""
    return F.lit(True) if limit is None else F.abs(roll) <= limit


def select_detections(rows: DataFrame, classes: list[int] | None = None, confidence: float = HIGH, min_area: float = MIN_BODY_AREA, max_iou: float | None = 0.55, most: int = MAX_DETECTIONS) -> DataFrame:
    """The detector's own filters in order: class and confidence, greedy
    suppression in each frame, the ``most`` best of a frame, then size."""
    kept = rows.withColumn("score", bounded_score(F.col("score"))).where(F.col("score") >= confidence)
    if classes is not None:
        kept = kept.where(F.col("class_id").isin(classes))
    if max_iou is not None:
        kept = assign.suppress(kept, FRAME, max_iou)
    rank = F.row_number().over(W.partitionBy(*FRAME).orderBy(F.desc("score"), "det"))
    return kept.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank").where(large_enough(box(), min_area))


def frame_pairs(a: DataFrame, b: DataFrame, names=("a_", "b_"), keys: list[str] = FRAME) -> DataFrame:
    """Every row of ``a`` with every row of ``b`` of the same frame, columns with
    the given prefixes. A frame's rows are few, however many frames there are."""
    left = a.select(*keys, *[F.col(c).alias(names[0] + c) for c in a.columns if c not in keys])
    right = b.select(*keys, *[F.col(c).alias(names[1] + c) for c in b.columns if c not in keys])
    return left.join(right, keys)


def overlapping(rows: DataFrame) -> DataFrame:
    """``iou`` of each two overlapping boxes of a frame, the smaller ``det`` first."""
    columns = rows.select(*FRAME, "det", "x1", "y1", "x2", "y2")
    a, b = box("a_"), box("b_")
    return frame_pairs(columns, columns).where(F.col("a_det") < F.col("b_det")).where(overlap(a, b) > 0).select(*FRAME, "a_det", "b_det", iou(a, b).alias("iou"))


def face_pairs(bodies: DataFrame, faces: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Bodies (``det, x1..``) with the faces (``face, fx1..``) of their frame: the
    share of the face ``inside``, and the ``cost`` of the pair, null if it is not feasible."""
    cost, feasible = assign.face_cost(box(), box("f"))
    both = faces.join(bodies.select(*keys, "det", "x1", "y1", "x2", "y2"), keys)
    return both.withColumn("inside", containment(box(), box("f"))).withColumn("cost", F.when(feasible, cost))


def unassigned(rows: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of which ``assigned`` has no partner (faces without a body, or bodies
    without a face). Rows with a null key have none."""
    return rows.join(assigned.select(*keys).distinct(), keys, "left_anti")


def combined(bodies: DataFrame, faces: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Per frame that either detector saw: how many of both, none counting as 0."""
    n = bodies.groupBy(*keys).agg(F.count("*").alias("n_bodies")).join(faces.groupBy(*keys).agg(F.count("*").alias("n_faces")), keys, "full")
    return n.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_bodies", "n_faces")})


def redaction_targets(faces: DataFrame, assigned: DataFrame, decisions: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Faces to make unrecognisable, with the reason: those of tracks without an
    accepted decision, and those that belong to no track."""
    who = [*keys, "face"]
    accepted = decisions.where("accepted").select("track").distinct()
    not_accepted = faces.join(assigned.select(*who, "track").join(accepted, "track", "left_anti").select(*who).distinct(), who, "left_semi").withColumn("why", F.lit("not_accepted"))
    return not_accepted.unionByName(unassigned(faces, assigned, who).withColumn("why", F.lit("unassigned")))


def label(track: Column, decided: Column, accepted: Column, identity: Column, similarity: Column, confidence: Column, unknown: str = "UNKNOWN") -> Column:
    """The text at a track's box: short id, identity or why there is none, confidence."""
    number = lambda x: F.format_string("%.2f", x)
    who = F.when(~F.coalesce(decided, F.lit(False)), F.lit("unresolved")).when(accepted, F.concat_ws(" ", identity, number(similarity))).otherwise(F.lit(unknown))
    return F.concat_ws(" ", F.concat(F.lit("#"), F.substring(track, 1, 8)), who, F.concat(F.lit("conf "), number(confidence)))
