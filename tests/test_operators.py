"""Behaviour of the operators that SQL does not express, and of the edges."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vectrail.operators import assign, frames, fusion, gallery, tracker
from vectrail.sources import gallery_table


def test_assignment_is_optimal():
    r = np.random.default_rng(3)
    for _ in range(300):
        rows, cols = r.integers(1, 6, 2)
        m = r.integers(-5, 9, (rows, cols)).astype(float)
        got = assign.assignment(m)
        assert len(got) == min(rows, cols) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        short, wide = (m, cols) if rows <= cols else (m.T, rows)
        best = min(sum(short[i, p[i]] for i in range(len(short))) for p in itertools.permutations(range(wide), len(short)))
        assert sum(m[i, j] for i, j in got) == pytest.approx(best)
    assert assign.assignment(np.zeros((0, 3))) == []


def feed(scene, settings=tracker.Settings(), first=0):
    t = tracker.Tracker(1, settings)
    return t, [[(x.track_id, x.motion.box) for x in t.step(first + f, np.array(b, float).reshape(-1, 4), np.array(s, float))] for f, (b, s) in enumerate(scene)]


def at(x, y, w=50, h=100):
    return [x, y, x + w, y + h]


def test_crossing_objects_keep_their_ids():
    _, out = feed([([at(100 + 8 * f, 100), at(340 - 8 * f, 100)], [0.9, 0.9]) for f in range(30)])
    start = {i: b[0] for i, b in out[3]}
    end = {i: b[0] for i, b in out[-1]}
    assert set(start) == set(end) and len(end) == 2
    assert (start[min(start, key=start.get)] < 200) and end[min(start, key=start.get)] > 200


def test_occlusion_is_bridged_and_expiry_is_not():
    seen = [([at(100 + 10 * f, 100)], [0.9]) for f in range(8)]
    back = [([at(100 + 10 * f, 100)], [0.9]) for f in range(18, 24)]
    t, out = feed(seen + [([], [])] * 10 + back)
    assert t.created == 1 and out[-1][0][0] == out[7][0][0]
    t, _ = feed(seen + [([], [])] * 40 + back)
    assert t.created == 2


def test_low_scores_sustain_but_do_not_create():
    t, out = feed([([at(100, 100)], [0.9])] * 6 + [([at(100, 100)], [0.2])] * 8)
    assert t.created == 1 and out[-1]
    t, _ = feed([([at(100, 100)], [0.05])] * 20)
    assert t.created == 0


def test_crowd():
    t, out = feed([([at(60 * i, 100 + 4 * f, 40, 80) for i in range(12)], [0.9] * 12) for f in range(15)], first=100)
    assert t.created == 12 and len(out[-1]) == 12


def test_two_state_filters_equal_the_joint_filter():
    r = np.random.default_rng(0)
    z = [np.array([100 + 5 * k, 50 + 2 * k, 5000.0, 0.5]) + r.normal(0, [1, 1, 20, 0.01]) for k in range(40)]
    box = lambda m: np.array([m[0] - np.sqrt(m[2] * m[3]) / 2, m[1] - np.sqrt(m[2] / m[3]) / 2, m[0] + np.sqrt(m[2] * m[3]) / 2, m[1] + np.sqrt(m[2] / m[3]) / 2])
    f, h = np.eye(7), np.eye(4, 7)
    f[0, 4] = f[1, 5] = f[2, 6] = 1
    noise, q = np.diag([1, 1, 10, 10.0]), np.diag([1, 1, 1, 1, 0.01, 0.01, 1e-4])
    x, p = np.r_[z[0], 0, 0, 0], np.diag([10, 10, 10, 10, 1e4, 1e4, 1e4])
    m = tracker.Motion(box(z[0]))
    for y in z[1:]:
        x, p = f @ x, f @ p @ f.T + q
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + noise)
        x, i = x + k @ (y - h @ x), np.eye(7) - k @ h
        p = i @ p @ i.T + k @ noise @ k.T
        m.predict()
        m.update(box(y))
    assert np.allclose([m.u.x, m.v.x, m.s.x, m.r, m.u.v, m.v.v, m.s.v], x, atol=1e-6)


def test_stream_equals_batch(spark, tmp_path):
    from vectrail.streaming.tracking import track_stream

    rows = pd.DataFrame([(s, f, d, 60.0 * d + 3 * f, 100.0 + 2 * f, 60.0 * d + 3 * f + 40, 180.0 + 2 * f, 0.9) for s in (1, 2) for f in range(20) for d in range(3)], columns=["stream_id", "frame_number", "det", "x1", "y1", "x2", "y2", "score"])
    want = tracker.track(spark.createDataFrame(rows)).select("stream_id", "frame_number", "track_id", F.round("x1", 6)).collect()
    src = str(tmp_path / "in")
    for a in range(0, 20, 5):
        spark.createDataFrame(rows[(rows.frame_number >= a) & (rows.frame_number < a + 5)]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.createDataFrame(rows).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = track_stream(stream).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("tracks").select("stream_id", "frame_number", "track_id", F.round("x1", 6)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_strangers_stay_unknown(spark):
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(r.normal(size=(50, 64)))
    entries = [(3 * i + k, f"p{i}", unit(c + r.normal(0, 0.05, 64)).tolist()) for i, c in enumerate(centres) for k in range(3)]
    g = spark.createDataFrame(entries, "entry_index bigint, identity string, vector array<double>")
    known = [(i, unit(c + r.normal(0, 0.05, 64)).tolist()) for i, c in enumerate(centres)]
    strangers = [(1000 + k, unit(r.normal(size=64)).tolist()) for k in range(200)]
    q = spark.createDataFrame(known + strangers, "query_id bigint, vector array<double>")
    threshold = gallery.calibrated_threshold(g).first()["threshold"]
    out = {x["query_id"]: x for x in gallery.decide(gallery.best_and_margin(gallery.top_hits(q, g)), max(threshold, 0.6)).collect()}
    assert all(out[i]["accepted"] and out[i]["identity"] == f"p{i}" for i in range(50))
    assert not any(out[1000 + k]["accepted"] for k in range(200))


def test_fusion_edges(spark):
    rows = [(1, 0, 1.0, [1.0, 0.0]), (1, 1, 1.0, [-1.0, 0.0]), (2, 0, 0.0, [0.0, 1.0])]
    s = spark.createDataFrame(rows, "track bigint, seq bigint, weight double, vector array<double>")
    got = {x["track"]: x["vector"] for x in fusion.weighted_mean(s).collect()}
    assert got == {1: None, 2: [0.0, 1.0]}
    many = spark.createDataFrame([(1, k, 1.0, [1.0, 0.0]) for k in range(200)], s.schema)
    assert fusion.coherence(many).first()["n_samples"] == 32


def test_sampling_drops_null_timestamps(spark):
    f = spark.createDataFrame([(1, None, 0), (1, 10, 1), (1, 20, 2), (1, 30, 3)], "stream_id bigint, pts bigint, packet_index bigint")
    assert [(x["pts"], x["frame_number"]) for x in frames.sample(f, stride=2).orderBy("pts").collect()] == [(10, 0), (30, 1)]


def test_gallery_table_checks(spark, tmp_path):
    good = spark.createDataFrame([(0, "a", [1.0, 0.0], "x")], gallery_table.SCHEMA)
    gallery_table.save(good, str(tmp_path / "g"))
    assert gallery_table.load(spark, str(tmp_path / "g")).count() == 1
    with pytest.raises(ValueError):
        gallery_table.save(good.limit(0), str(tmp_path / "h"))
    with pytest.raises(Exception, match="bad vector"):
        gallery_table.checked(spark.createDataFrame([(0, "a", [2.0, 0.0], "x")], gallery_table.SCHEMA)).collect()


def test_incoherent_tracks_are_rejected_first(spark):
    rows = [(1, "a", 0.9, None, None, 0.69), (2, "a", 0.9, None, None, 0.7), (3, None, None, None, None, 0.1), (4, "a", 0.9, 0.88, 0.02, None), (5, "a", 0.9, 0.88, 0.02, 0.9), (6, "a", 0.9, None, None, float("nan"))]
    b = spark.createDataFrame(rows, "query_id bigint, identity string, similarity double, runner_up double, margin double, coherence double")
    got = {x["query_id"]: x for x in gallery.decide(b, 0.35, coherence="coherence").collect()}
    assert {k: x["reason"] for k, x in got.items()} == {1: "incoherent", 2: "accepted", 3: "incoherent", 4: "incoherent", 5: "ambiguous", 6: "incoherent"}
    assert (got[1]["identity"], got[1]["similarity"], got[1]["margin"], got[1]["accepted"]) == (None, 0.0, 0.0, False)


def test_search_leaves_out_identities_without_consent(spark):
    g = spark.createDataFrame([(k, i, [1.0, 0.0]) for k, i in enumerate(["ok", "expired", "blank", "absent", None, "open"])], "entry_index bigint, identity string, vector array<double>")
    c = spark.createDataFrame([("ok", "signed", "2030-01-01"), ("expired", "signed", "2020-01-01"), ("blank", " ", None), ("open", "signed", None), (None, "signed", None)], "identity string, basis string, expires_on string").withColumn("expires_on", F.col("expires_on").cast("date"))
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, vector array<double>")
    today = F.lit("2024-06-01").cast("date")
    assert {x["identity"] for x in gallery.consented_hits(q, g, c, today).collect()} == {"ok", "open"}
    assert gallery.consented_hits(q, g, c.limit(0), today).count() == 0
