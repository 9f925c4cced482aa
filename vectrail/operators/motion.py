"""Motion of single tracks from their observations, as columns: the filtered box
after every observation, and the heading between two observations.

Observations are rows with the columns of ``keys``, ``frame_number`` and a box
(``x1, y1, x2, y2``), one a frame.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions.geometry import direction_consistency

#: Measurement noise, and process noise of a value and of its velocity.
NOISE = {"u": (1.0, 1.0, 0.01), "v": (1.0, 1.0, 0.01), "s": (10.0, 1.0, 0.0001)}
#: Of the aspect ratio, which has no velocity.
RATIO_NOISE = (10.0, 1.0)
#: Covariance at the start: of a value, of its velocity.
START = (10.0, 10_000.0)
#: What is kept of the state after an observation.
STATE = ("u", "du", "v", "dv", "s", "ds", "ratio", "spread")


def measured() -> list[Column]:
    """Centre (``u, v``), area ``s`` and aspect ratio ``r`` of a box."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ratio = F.when(h == 0, 0.0).otherwise(w / h)
    return [((F.col("x1") + F.col("x2")) / 2).cast("double").alias("u"), ((F.col("y1") + F.col("y2")) / 2).cast("double").alias("v"), F.greatest((w * h).cast("double"), F.lit(1.0)).alias("s"), F.greatest(ratio.cast("double"), F.lit(1e-6)).alias("r")]


def spread(a: float, b: float, c: float, k: float, name: str) -> tuple[float, float, float]:
    """The covariance of a value and its velocity ``k`` frames later: k steps of one frame, summed."""
    _, q, qd = NOISE[name]
    return a + 2 * k * b + k * k * c + k * q + qd * ((k - 1) * k * (2 * k - 1) / 6), b + k * c + qd * (k * (k - 1) / 2), c + k * qd


class Folded:
    """The filter over one track after another: the state after the last observation, and
    no more, is held. The axes u and v have the same noise, so one covariance."""

    def start(self, frame: int, u: float, v: float, s: float, r: float) -> None:
        self.frame = frame
        self.values = (u, 0.0, v, 0.0, s, 0.0, r)
        self.spreads = (START[0], 0.0, START[1], START[0], 0.0, START[1], START[0])

    def step(self, frame: int, zu: float, zv: float, zs: float, zr: float) -> None:
        """The frames up to an observation, and the observation."""
        ux, ud, vx, vd, sx, sd, ratio = self.values
        a, b, c, sa, sb, sc, p = self.spreads
        k = float(frame - self.frame)
        self.frame = frame
        ux, vx = ux + k * ud, vx + k * vd
        # an area stays where a step would take it to zero or below, and loses its trend
        steps = 0.0
        if sx + sd > 0:
            some = sx / -sd if sd < 0 else math.inf
            steps = k if some > k + 1 else math.ceil(some) - 1.0
        sx, sd = sx + steps * sd, 0.0 if steps < k else sd
        a, b, c = spread(a, b, c, k, "u")
        sa, sb, sc = spread(sa, sb, sc, k, "s")
        gain, rate = a / (a + NOISE["u"][0]), b / (a + NOISE["u"][0])
        off_u, off_v = zu - ux, zv - vx
        s_gain, s_rate = sa / (sa + NOISE["s"][0]), sb / (sa + NOISE["s"][0])
        off_s = zs - sx
        p += k * RATIO_NOISE[1]
        r_gain = p / (p + RATIO_NOISE[0])
        self.values = (ux + gain * off_u, ud + rate * off_u, vx + gain * off_v, vd + rate * off_v, sx + s_gain * off_s, sd + s_rate * off_s, ratio + r_gain * (zr - ratio))
        self.spreads = ((1 - gain) * a, (1 - gain) * b, c - rate * b, (1 - s_gain) * sa, (1 - s_gain) * sb, sc - s_rate * sb, p * (1 - r_gain))


def filtered(observations: DataFrame, keys: tuple[str, ...] = ("stream_id", "track")) -> DataFrame:
    """Per observation: ``keys``, ``frame_number``, the filtered box, ``du, dv``
    (velocity of the centre, a frame) and ``uncertainty`` (variance of the
    centre, both axes). The first observation starts the filter; frames without one
    are predicted. A constant-velocity filter's blocks do not mix, so it is three
    filters of two numbers and one of one. The area's step is not linear, so a track is
    folded in order: rows are dealt by track and sorted by frame, and a task reads them
    as they come and holds one batch and one state, however long a track is.
    Repeated frames of a track count once; null frames or boxes take no part."""
    corners = ["x1", "y1", "x2", "y2"]
    whole = observations.where(F.col("frame_number").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull())
    rows = whole.select(*keys, F.col("frame_number").cast("bigint").alias("frame_number"), *corners)
    # a few long tracks are often all there is, so more partitions than a small session's
    session = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(session, min(4 * session, 128))
    dealt = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "frame_number", *corners)
    n = len(keys)

    def run(batches):
        fold, last, seen = Folded(), None, None
        for batch in batches:
            names, frames, *z = [c.to_pylist() for c in batch.columns[:n]], *[c.to_pylist() for c in batch.columns[n:]]
            out, kept = [], []
            for at, (key, frame, u, v, s, r) in enumerate(zip(zip(*names, strict=True), frames, *z, strict=True)):
                if key != last:
                    fold.start(frame, u, v, s, r)
                elif frame != seen:
                    fold.step(frame, u, v, s, r)
                else:
                    continue  # of a frame's boxes the first in order
                last, seen = key, frame
                kept.append(at)
                out.append((*fold.values, fold.spreads[0]))
            if kept:
                some = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*some.columns[: n + 1], *[pa.array(c, pa.float64()) for c in zip(*out, strict=True)]], names=[*some.schema.names[: n + 1], *STATE])

    kinds = [f for f in rows.schema if f.name in (*keys, "frame_number")]
    states = dealt.select(*keys, "frame_number", *measured()).mapInArrow(run, T.StructType([*kinds, *[T.StructField(c, T.DoubleType()) for c in STATE]]))
    area, ratio = F.greatest("s", F.lit(1.0)), F.greatest("ratio", F.lit(1e-6))
    out = states.select(*keys, "frame_number", "u", "v", "du", "dv", "spread", area.alias("area"), F.sqrt(area * ratio).alias("w"))
    half_w, half_h = F.col("w") / 2, F.col("area") / F.col("w") / 2
    return out.select(*keys, "frame_number", (F.col("u") - half_w).alias("x1"), (F.col("v") - half_h).alias("y1"), (F.col("u") + half_w).alias("x2"), (F.col("v") + half_h).alias("y2"), "du", "dv", (F.col("spread") + F.col("spread")).alias("uncertainty"))


def memory(delta: int) -> int:
    """Frames for which an observation is remembered."""
    return max(4 * delta, 16)


def chunked(rows: DataFrame, before: int, size: int = 4096) -> DataFrame:
    """``rows`` with ``chunk``, by frame number; a row among the last ``before`` frames of a
    chunk is also sent to the next one, where it is not ``own``. A window over
    keys and chunk then sees what a window over the keys would see of the last
    ``before`` frames, and a long track is not one task."""
    chunk = F.floor(F.col("frame_number") / size).cast("bigint")
    both = F.when(F.pmod("frame_number", F.lit(size)) >= size - before, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return rows.withColumn("chunk", F.explode(both)).withColumn("own", F.col("chunk") == chunk)


def earlier(observations: DataFrame, delta: int = 3, keys: tuple[str, ...] = ("stream_id", "track")) -> DataFrame:
    """``observations`` with ``earlier``, the observation from which the heading at each
    one is measured: that of the first frame, of the ``delta`` frames before, that
    has one; else the earliest that is remembered; null without any. As a struct
    of ``frame_number, cx, cy``."""
    if delta < 1:
        raise ValueError("delta must be at least 1")
    rows = chunked(observations.where("frame_number is not null"), memory(delta))
    w = W.partitionBy(*keys, "chunk").orderBy("frame_number")
    seen = F.struct("frame_number", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    near = F.first(seen).over(w.rangeBetween(-delta, -1))
    kept = F.first(seen).over(w.rangeBetween(-memory(delta), -1))
    return rows.withColumn("earlier", F.coalesce(near, kept)).where("own").drop("chunk", "own")


def headings(observations: DataFrame, delta: int = 3, keys: tuple[str, ...] = ("stream_id", "track")) -> DataFrame:
    """``observations`` with ``hx, hy``: the unit vector from the earlier observation, (0, 0)
    where there is none or the centre did not move."""
    rows = earlier(observations, delta, keys)
    dx, dy = (F.col("x1") + F.col("x2")) / 2 - F.col("earlier.cx"), (F.col("y1") + F.col("y2")) / 2 - F.col("earlier.cy")
    n = F.sqrt(dx * dx + dy * dy)
    unit = lambda d: F.when(n > 1e-6, d / n).otherwise(0.0)
    return rows.select(*observations.columns, F.col("earlier.frame_number").alias("since"), unit(dx).alias("hx"), unit(dy).alias("hy"))


def going_on(observations: DataFrame, delta: int = 3, keys: tuple[str, ...] = ("stream_id", "track")) -> DataFrame:
    """``observations`` with ``consistency``: 0..1, how well each one goes on in the heading of the
    one before; 0.5 where that has none, null for a track's first."""
    rows = headings(observations, delta, keys)
    before = F.lag(F.struct(((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), "hx", "hy")).over(W.partitionBy(*keys).orderBy("frame_number"))
    rows = rows.withColumn("before", before)
    b = F.col("before")
    ahead = direction_consistency(b["cx"], b["cy"], (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, b["hx"], b["hy"])
    return rows.withColumn("consistency", F.when(b.isNotNull(), ahead)).drop("before")
