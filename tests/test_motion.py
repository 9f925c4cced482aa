"""Motion, headings and lives as columns against the tracker's kernel, observation by observation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vectrail.operators import lifecycle, motion
from vectrail.operators.tracker import Motion, Settings, Track


def observed(seed, tracks=6, frames=400):
    """(stream, track, frame, box, score) with short and long gaps."""
    r = random.Random(seed)
    rows = []
    for t in range(tracks):
        frame, x, y, w, h = r.randrange(-50, 50), 100.0, 80.0, 40.0, 90.0
        for _ in range(r.choice([1, 2, 130, frames])):
            rows.append((t % 2, f"t{t}", frame, x, y, x + w, y + h, r.random()))
            frame += r.choice([1] * 12 + [2, 3, 5, 17, 20, 32, 33, 60])
            x, y, w, h = x + r.uniform(-4, 6), y + r.uniform(-3, 3), max(2.0, w * r.uniform(0.8, 1.2)), max(2.0, h * r.uniform(0.8, 1.2))
    return rows


SCHEMA = "stream_id bigint, track string, frame_number bigint, x1 double, y1 double, x2 double, y2 double, score double"


def by_track(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        found.setdefault(r[:2], []).append(r)
    return found


def test_filter_equals_frame_by_frame_steps(spark):
    rows = observed(1)
    got = {(r["stream_id"], r["track"], r["frame_number"]): tuple(r)[3:] for r in motion.filtered(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for key, seen in by_track(rows).items():
        m, last = None, None
        for *_, frame, x1, y1, x2, y2, _ in [r for r in seen]:
            if m is None:
                m = Motion((x1, y1, x2, y2))
            else:
                for _ in range(frame - last):
                    m.predict()
                m.update((x1, y1, x2, y2))
            last = frame
            want = (*m.box, m.u.v, m.v.v, m.u.a + m.v.a)
            assert all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-6) for a, b in zip(got[*key, frame], want, strict=True)), (key, frame)


def test_filter_of_shrinking_boxes_and_odd_rows(spark):
    # the area's trend would take it below zero within the gap
    rows = [(0, "a", f, 0.0, 0.0, 100.0 - 8 * f, 100.0 - 8 * f, 1.0) for f in range(11)] + [(0, "a", 60, 0.0, 0.0, 10.0, 10.0, 1.0)]
    m = Motion(rows[0][3:7])
    for before, row in zip(rows, rows[1:], strict=False):
        for _ in range(row[2] - before[2]):
            m.predict()
        m.update(row[3:7])
    odd = [(0, "a", None, 1.0, 1.0, 2.0, 2.0, 1.0), (0, "b", 1, None, 1.0, 2.0, 2.0, 1.0), rows[3]]
    got = motion.filtered(spark.createDataFrame(rows + odd, SCHEMA)).orderBy("frame_number").collect()
    assert [r["frame_number"] for r in got] == [*range(11), 60]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(tuple(got[-1])[3:7], m.box, strict=True))
    assert motion.filtered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_of_a_long_track_is_not_gathered(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("0L AS stream_id", "'a' AS track", "id AS frame_number", "double(id % 97) AS x1", "double(id % 89) AS y1", "double(id % 97 + 20 + id % 7) AS x2", "double(id % 89 + 40) AS y2")
    found = motion.filtered(rows.repartition(5))
    assert "collect_list" not in found._jdf.queryExecution().toString()  # no row or group that grows with a track
    m = None
    for k, r in enumerate(found.orderBy("frame_number").collect()):
        box = (float(k % 97), float(k % 89), float(k % 97 + 20 + k % 7), float(k % 89 + 40))
        if m is None:
            m = Motion(box)
        else:
            m.predict()
            m.update(box)
        assert r["frame_number"] == k and math.isclose(r["x1"], m.box[0], rel_tol=1e-7, abs_tol=1e-6) and math.isclose(r["y2"], m.box[3], rel_tol=1e-7, abs_tol=1e-6)
    assert k == n - 1


@pytest.mark.parametrize("delta", [1, 3, 6])
def test_headings_equal_the_kernel(spark, delta):
    rows = observed(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r["stream_id"], r["track"], r["frame_number"]): (r["hx"], r["hy"]) for r in motion.headings(df, delta).collect()}
    s = Settings(delta=delta)
    for key, seen in by_track(rows).items():
        t = Track("x", seen[0][2], Motion(seen[0][3:7]), 1.0)
        for row in seen:
            t.remember(row[2], row[3:7], 1.0, s)
            assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[*key, row[2]], t.heading(delta), strict=True))
    on = motion.going_on(df, delta).collect()
    assert len(on) == len(rows) and sum(r["consistency"] is None for r in on) == len(by_track(rows))
    with pytest.raises(ValueError):
        motion.headings(df, 0)


def test_headings_across_chunks(spark):
    rows = [(0, "a", f, float(f * f % 97), 0.0, float(f * f % 97) + 10, 10.0 + f, 1.0) for f in [*range(4080, 4100), 4110, 8191, 8192, 8193, 12_300]]
    df = spark.createDataFrame(rows, SCHEMA)
    assert motion.chunked(df, 16).where("own").count() == len(rows)
    got = {r["frame_number"]: r["since"] for r in motion.headings(df).collect()}
    assert got[4096] == 4093 and got[4110] == 4094 and got[8192] == 8191 and got[8193] == 8191 and got[12_300] is None and got[4080] is None


def stepped_lives(frames, s):
    """States per frame by the kernel's own steps: (life, frame, state, hits, missed, age, remembered)."""
    out, life, t, left = [], 0, None, sorted(set(frames))
    frame, box = left[0], (0.0, 0.0, 10.0, 10.0)
    while left or t:
        if t:
            t.age, t.missed = t.age + 1, t.missed + 1
        if left and frame == left[0]:
            left.pop(0)
            if t:
                t.observe(frame, box, 1.0, s)
            else:
                life += 1
                t = Track("x", frame, Motion(box), 1.0)
                t.remember(frame, box, 1.0, s)
        elif t:
            t.miss(s)
        if t:
            out.append((life, frame, t.state, t.hits, t.missed, t.age, len(t.seen)))
            if t.state == "removed":
                t = None
        frame = frame + 1 if t or not left else left[0]
    return out


@pytest.mark.parametrize(("min_hits", "max_age"), [(3, 30), (1, 2), (5, 4)])
def test_lives_equal_the_kernel(spark, min_hits, max_age):
    r = random.Random(min_hits)
    tracks = {}
    for k in range(30):
        frame, frames = r.randrange(-20, 20), []
        for _ in range(r.randrange(1, 40)):
            frames.append(frame)
            frame += r.choice([1, 1, 1, 2, 3, max_age, max_age + 1, max_age + 2, 50])
        tracks[f"t{k}"] = frames
    rows = [(1, t, f) for t, frames in tracks.items() for f in frames] + [(1, "t0", None), (1, "t0", tracks["t0"][0])]
    got = lifecycle.states(spark.createDataFrame(rows, "stream_id bigint, track string, frame_number bigint"), min_hits=min_hits, max_age=max_age).collect()
    found = {}
    for x in got:
        found.setdefault(x["track"], []).append(tuple(x)[2:])
    s = Settings(min_hits=min_hits, max_age=max_age)
    for t, frames in tracks.items():
        assert sorted(found[t], key=lambda x: (x[0], x[1])) == stepped_lives(frames, s), t


def test_confidence_equals_the_kernel(spark):
    rows = [r for r in observed(4, 4, 90)]
    got = {(r["stream_id"], r["track"], r["frame_number"]): r["confidence"] for r in lifecycle.scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    s = Settings()
    for key, seen in by_track(rows).items():
        t, last = None, None
        for row in seen:
            if t and (row[2] - last - 1 > s.max_age or row[2] - last > 1 and t.state == "tentative"):
                t = None
            if t:
                t.observe(row[2], row[3:7], row[7], s)
            else:
                t = Track("x", row[2], Motion(row[3:7]), row[7])
                t.remember(row[2], row[3:7], row[7], s)
            last = row[2]
            assert math.isclose(got[*key, row[2]], t.confidence(s), abs_tol=1e-12)
    one = spark.range(1).select(lifecycle.confidence(F.lit(0.5), F.lit(1), F.lit(15)).alias("c")).first()["c"]
    assert math.isclose(one, 0.25 + 0.2 / 3 + 0.15)
