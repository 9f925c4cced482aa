"""Decisions as tracks grow, against a plain loop over each track's samples."""

import datetime
import math
import random
import statistics
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.operators import governance, progress

SCHEMA = "track string, seq bigint, weight double, vector array<double>"


def unit(v):
    n = np.linalg.norm(v)
    return None if n < 1e-8 else v / n


def fused(kept, strategy):
    w, v = np.array([x[0] for x in kept]), np.array([x[1] for x in kept])
    if strategy == "median":
        return unit(np.array([statistics.median(c) for c in v.T]))
    if strategy == "ema":
        out = v[0]
        for a, x in zip(w[1:], v[1:], strict=True):
            out = (1 - 0.3 * a) * out + 0.3 * a * x
        return unit(out)
    return unit((v * w[:, None]).sum(0) / w.sum() if w.sum() >= 1e-8 else v.mean(0))


def plain(rows, strategy="weighted_mean", count_all=False):
    """(track, seen) -> (n_samples, seq, vector, mean weight, coherence)"""
    out = {}
    for track in {r[0] for r in rows}:
        kept, last, seen = deque(maxlen=32), None, 0
        for _, seq, w, v in sorted((r for r in rows if r[0] == track), key=lambda r: r[1]):
            kept.append((w, np.array(v)))
            seen += 1
            n = seen if count_all else len(kept)
            if n < 3 or not count_all and seen > 32:
                continue
            if (n - 3) % 5 if count_all else last is not None and n - last < 5:
                continue
            vector = fused(kept, strategy)
            if vector is None:
                continue
            last = n
            pairs = [float(a @ b) for i, (_, a) in enumerate(kept) for j, (_, b) in enumerate(kept) if i != j]
            out[track, seen] = len(kept), seq, vector, sum(w for w, _ in kept) / len(kept), sum(pairs) / len(pairs)
    return out


def walks(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for t, n in enumerate([1, 2, 3, 4, 8, 31, 32, 33, 70, 203, 320]):
        base = r.normal(size=4)
        rows += [(f"t{t}", int(5 * k - 40), float(r.random()), (unit(base + 0.3 * r.normal(size=4))).tolist()) for k in range(n)]
    # vanishes with its third sample, and is tried again with the fourth
    rows += [("zero", k, 0.5, v) for k, v in enumerate([[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0], [0.0, 1.0], *[[0.6, 0.8]] * 9])]
    rows += [("light", k, 0.0, [0.6, 0.8]) for k in range(6)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize(("strategy", "count_all"), [("weighted_mean", False), ("median", False), ("ema", False), ("weighted_mean", True), ("median", True)])
def test_points_match_a_plain_loop(spark, strategy, count_all):
    rows = walks()
    got = {(r["track"], r["seen"]): r for r in progress.growing(spark.createDataFrame(rows, SCHEMA).repartition(3), strategy, count_all=count_all).collect()}
    want = plain(rows, strategy, count_all)
    assert got.keys() == want.keys()
    for key, (n, seq, vector, weight, coherence) in want.items():
        r = got[key]
        assert (r["n_samples"], r["seq"]) == (n, seq)
        assert np.allclose(r["vector"], vector, atol=1e-12) and math.isclose(r["mean_weight"], weight, abs_tol=1e-12) and math.isclose(r["coherence"], coherence, abs_tol=1e-12)
    if not count_all and strategy == "weighted_mean":
        assert sorted(s for t, s in want if t == "zero") == [4, 9] and max(s for _, s in want) == 28
    if count_all:
        assert max(s for t, s in want if t == "t10") == 318


def test_schedule_and_empty_tables(spark):
    with pytest.raises(ValueError):
        progress.growing(spark.createDataFrame([], SCHEMA), "ema", count_all=True)
    for count_all in (False, True):
        assert progress.growing(spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 1.0, [1.0])], SCHEMA), count_all=count_all).count() == 0


def test_last_decision_stands_and_the_final_pass_decides_the_rest(spark):
    one, two = [1.0, 0.0], [0.0, 1.0]
    rows = [("turns", k, 1.0, one if k < 4 else two) for k in range(28)]
    rows += [("mixed", k, 1.0, one if k % 2 else two) for k in range(3)]
    rows += [("late", k, 1.0, [0.0, 0.0] if k < 32 else one) for k in range(36)] + [("short", 0, 1.0, one)]
    entries = spark.createDataFrame([(0, "first", one), (1, "second", two)], "entry_index bigint, identity string, vector array<double>")
    every = progress.decided(spark.createDataFrame(rows, SCHEMA), entries, 0.35)
    by = {(r["track"], r["seen"]): r for r in every.collect()}
    assert {t for t, _ in by} == {"turns", "mixed", "late"}
    assert by["turns", 3]["identity"] == "first" and by["turns", 3]["reason"] == "accepted"
    assert by["mixed", 3]["reason"] == "incoherent" and by["mixed", 3]["identity"] is None
    late = by["late", 32]
    assert late["finalised"] and late["seq"] is None and late["reason"] == "incoherent"  # zero vectors agree with nothing
    last = {r["track"]: r for r in progress.standing(every).collect()}
    assert last["turns"]["seen"] == 28 and last["turns"]["identity"] == "second" and set(last) == {"turns", "mixed", "late"}

    now = F.lit(datetime.datetime(2024, 1, 2))
    log = {(r["track_id"], r["frame_number"]): r for r in governance.identifications(every, F.lit(0.35), "cam", F.col("seq") * 2.0, now=now).collect()}
    assert len(log) == len(by)
    final = log["late", -1]
    assert (final["identity"], final["margin"], final["media_seconds"], final["finalised"], final["embeddings_fused"], final["source"]) == ("UNKNOWN", 0.0, None, True, 32, "cam")
    good = log["turns", 2]
    assert (good["identity"], good["similarity"], good["threshold"], good["media_seconds"], good["rejection_reason"], good["coherence"]) == ("first", 1.0, 0.35, 4.0, None, 1.0)
