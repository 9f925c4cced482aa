"""Rule-based quality gate with a self-calibrating norm threshold."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions.geometry import clamp
from vectrail.operators.order import numbered

MIN_NORM, MAX_NORM = 18.0, 48.0


def score() -> Column:
    """The weighted composite of norm, sharpness, size, light, truncation and detector."""
    blur = blur_limit()
    norm = F.when(F.col("norm_calibrated"), clamp((F.col("norm") - 18) / 30)).otherwise(0.5)
    return 0.3 * norm + 0.2 * clamp(F.col("sharpness") / (4 * blur + 1e-6)) + 0.2 * clamp((F.col("eye_distance") - 20) / 40) + 0.1 * clamp(1 - F.abs(F.col("brightness") - 130) / 105) + 0.1 * clamp(1 - F.col("truncation")) + 0.1 * clamp(F.col("detection_score"))


#: Calibrated rows of a stream that one task goes through, besides those it starts from.
CHUNK_ROWS = 20_000


def adaptive_threshold(rows: DataFrame, percent: float = 0.35, ring: int = 512, warmup: int = 64, floor: float = MIN_NORM, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Calibrated rows with ``threshold``: a percentile of the ``ring`` norms
    before, once ``warmup`` of them are there, never under ``floor``.

    A stream is cut into chunks, each with the ``ring`` rows before it, so a long
    stream has many tasks. A task holds the ring as a sorted list. A null norm has
    its place in the ring, but no value in the percentile."""
    calibrated = rows.where("norm_calibrated")
    n = numbered(calibrated, "stream_id", ["seq"], "__n")
    own = F.floor(F.col("__n") / chunk).cast("int")
    # the last rows of a chunk also start the next one
    chunks = F.when(F.col("__n") % chunk >= chunk - min(ring, chunk), F.array(own, own + 1)).otherwise(F.array(own))
    if ring > chunk:
        raise ValueError("a chunk must hold the ring")
    dealt = n.withColumn("__own", own).withColumn("__chunk", F.explode(chunks)).repartition("stream_id", "__chunk").sortWithinPartitions("stream_id", "__chunk", "__n")
    schema = T.StructType([*calibrated.schema.fields, T.StructField("threshold", T.DoubleType())])

    columns = calibrated.columns

    def run(batches):
        at, held, values = None, deque(), []
        for b in batches:
            keys = list(zip(b.column("stream_id").to_pylist(), b.column("__chunk").to_pylist(), b.column("__own").to_pylist(), strict=True))
            out = np.full(b.num_rows, floor)
            keep = np.zeros(b.num_rows, bool)
            for k, ((stream, part, home), norm) in enumerate(zip(keys, b.column("norm").to_pylist(), strict=True)):
                if (stream, part) != at:
                    at, held, values = (stream, part), deque(), []
                if part == home:
                    keep[k] = True
                    if len(held) >= warmup and values:
                        place = percent * (len(values) - 1)
                        low = int(place)
                        high = min(low + 1, len(values) - 1)
                        out[k] = max(values[low] + (place - low) * (values[high] - values[low]), floor)
                held.append(norm)
                if norm is not None:
                    insort(values, norm)
                if len(held) > ring and (old := held.popleft()) is not None:
                    del values[bisect_left(values, old)]
            part = b.select(columns).append_column("threshold", pa.array(out)).filter(pa.array(keep))
            if part.num_rows:
                yield part

    return dealt.mapInArrow(run, schema)


def assess(rows: DataFrame, min_norm: Column | float = MIN_NORM) -> DataFrame:
    """``rows`` with ``score``, all failed ``reasons``, ``passed``, and the
    threshold that sharpness had to reach."""
    return rows.withColumns({"score": score(), "reasons": reasons(min_norm), "sharpness_threshold": blur_limit()}).withColumn("passed", F.size("reasons") == 0)


def gated(rows: DataFrame, keys: list[str] | None = None, **options) -> DataFrame:
    """``assess`` with the adaptive norm threshold of each row's stream;
    rows without a calibrated norm have none and are not held to it."""
    keys = keys or ["stream_id", "seq"]
    limits = adaptive_threshold(rows, **options).select(*keys, F.col("threshold").alias("norm_threshold"))
    return assess(rows.join(limits, keys, "left"), F.coalesce("norm_threshold", F.lit(options.get("floor", MIN_NORM))))


def gate_report(assessed: DataFrame) -> DataFrame:
    """One row: how many were assessed and passed, and the rate; 0 if there are none."""
    return assessed.agg(F.count("*").alias("n_assessed"), F.count_if("passed").alias("n_passed"), F.coalesce(F.try_divide(F.count_if("passed"), F.count("*")), F.lit(0.0)).alias("pass_rate"))


def blur_limit() -> Column:
    """What sharpness must reach: less for crops that were scaled up."""
    return 45 / F.pow(F.greatest(F.col("scale"), F.lit(1.0)), 2)


def reasons(min_norm: Column | float = MIN_NORM) -> Column:
    """All failed rules in fixed order."""
    min_norm = min_norm if isinstance(min_norm, Column) else F.lit(min_norm)
    blur = blur_limit()
    rules = [
        ("detector", F.col("detection_score") < 0.6),
        ("blur", F.col("sharpness") < blur),
        ("illumination", (F.col("brightness") < 25) | (F.col("brightness") > 235)),
        ("truncation", F.col("truncation") > 0.1),
        ("eye_distance", F.col("eye_distance") < 20),
        ("norm_low", F.col("norm_calibrated") & (F.col("norm") < min_norm)),
        ("norm_high", F.col("norm_calibrated") & (F.col("norm") > MAX_NORM)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
