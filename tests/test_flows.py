"""Edges of the frame flow, decisions, enrolment, consent and checks."""

import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vectrail.functions.geometry import Box
from vectrail.operators import align, assign, detections, enrolment, frames, fusion, gallery, governance, quality_gate, reports, tracker
from vectrail.sources import checks, gallery_table

BOXES = "stream_id bigint, frame_number bigint, det bigint, x1 double, y1 double, x2 double, y2 double, score double"


def test_strict_timestamps(spark):
    f = spark.createDataFrame([(1, 10, 5, 0), (1, 20, None, 1)], "stream_id bigint, pts bigint, dts bigint, packet_index bigint")
    assert frames.strict(f).count() == 2 == frames.strict(f.where("dts = 5"), allow_missing_dts=False).count() + 1
    with pytest.raises(Exception, match="no timestamp: stream 1, packet 1"):
        frames.strict(f, allow_missing_dts=False).collect()
    with pytest.raises(Exception, match="no timestamp"):
        frames.strict(f.withColumn("pts", F.lit(None).cast("bigint"))).collect()
    assert frames.increasing(f).count() == 2
    with pytest.raises(Exception, match="do not increase: stream 1, pts 10"):
        frames.increasing(f.withColumn("pts", F.lit(10).cast("bigint"))).collect()


def test_schedules(spark):
    pts = {m: [r["pts"] for r in frames.schedule(spark, m).orderBy("frame_number").collect()] for m in ("cfr", "vfr", "gap")}
    assert set(np.diff(pts["cfr"])) == {3600} and len(pts["cfr"]) == 101 and pts["cfr"][-1] == 360_000
    assert set(np.diff(pts["vfr"])) == {3000, 6000, 11250} and list(np.diff(pts["gap"])).count(225_000) == 1 and pts["gap"][-1] > 360_000 > pts["gap"][-2]
    with pytest.raises(ValueError):
        frames.schedule(spark, "other")


def test_suppression_and_pairs_with_null_frames(spark):
    rows = [(None, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (None, 1, 2, 0.0, 0.0, 10.0, 10.0, 0.8), (1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 1, 2, 0.0, 0.0, 10.0, 10.0, 0.6), (1, None, 1, 0.0, 0.0, 10.0, 10.0, 0.6)]
    d = spark.createDataFrame(rows, BOXES)
    kept = sorted(((r["stream_id"], r["frame_number"], r["det"]) for r in assign.suppress(d, ["stream_id", "frame_number"]).collect()), key=str)
    assert kept == sorted([(None, 1, 1), (1, 1, 2), (1, None, 1)], key=str)
    assert [(r["a_det"], r["b_det"], r["iou"]) for r in detections.overlapping(d).collect()] == [(1, 2, 1.0)]
    assert detections.overlapping(d.limit(0)).count() == 0 == assign.suppress(d.limit(0), ["stream_id"]).count()
    many = spark.createDataFrame([(1, 1, k, 20.0 * k, 0.0, 20.0 * k + 30, 30.0, 0.9) for k in range(400)], BOXES).withColumn("class_id", F.lit(0))
    assert detections.select_detections(many, [0], min_area=1).count() == 300 and detections.select_detections(many, [1]).count() == 0
    assert detections.select_detections(many.withColumn("score", F.lit(1.5)), [0]).agg(F.max("score")).first()[0] == 1.0


def brute_assignment(costs, limit):
    """Least total cost over all one-to-one pairings, where infeasible pairs cost 1 + limit."""
    rows, cols = costs.shape
    if rows > cols:
        return brute_assignment(costs.T, limit)
    return min(sum(costs[i, p[i]] for i in range(rows)) for p in itertools.permutations(range(cols), rows))


def test_assignments_against_permutations(spark):
    from vectrail.plans.queries import QUERIES, _face_pairs

    sf = "/root/testdata/sf0.001"
    pairs = _face_pairs(spark, sf).where("cost is not null").toPandas()
    got = QUERIES["assignments"](spark, sf).toPandas()
    taken = {k: g for k, g in got.groupby(["stream_id", "frame_number"])}
    for key, g in pairs.groupby(["stream_id", "frame_number"]):
        dets, faces = sorted(set(g.det)), sorted(set(g.face))
        m = np.full((len(dets), len(faces)), 1 + assign.MAX_COST)
        for r in g.itertuples():
            m[dets.index(r.det), faces.index(r.face)] = r.cost
        if max(m.shape) > 7:
            continue
        mine = taken.get(key)
        used = [] if mine is None else list(zip(mine.det, mine.face, mine.cost, strict=True))
        assert len({d for d, _, _ in used}) == len({f for _, f, _ in used}) == len(used)
        assert all(c <= assign.MAX_COST and abs(m[dets.index(d), faces.index(f)] - c) < 1e-5 for d, f, c in used)
        total = sum(c for *_, c in used) + (min(m.shape) - len(used)) * (1 + assign.MAX_COST)
        # pairs over the limit are left out after solving, so what they cost there is at most as much
        assert brute_assignment(m, assign.MAX_COST) <= total + 1e-5
    assert len(got) > 500


def test_redaction_covers_every_face_without_an_accepted_track(spark):
    faces = spark.createDataFrame([(1, 1, k) for k in range(5)], "stream_id bigint, frame_number bigint, face bigint")
    assigned = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 1, 2, "c")], "stream_id bigint, frame_number bigint, face bigint, track string")
    d = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 2, False)], "track string, seq bigint, accepted boolean")
    got = {r["face"]: r["why"] for r in detections.redaction_targets(faces, assigned, governance.latest(d)).collect()}
    assert got == {1: "not_accepted", 2: "not_accepted", 3: "unassigned", 4: "unassigned"}
    none = detections.redaction_targets(faces, assigned.limit(0), d.limit(0))
    assert none.count() == 5 and detections.redaction_targets(faces.limit(0), assigned, d).count() == 0


def test_fusion_gate_and_restart(spark):
    schema = "track bigint, seq bigint, weight double, vector array<double>"
    s = spark.createDataFrame([(1, 0, 1.0, [1.0, 0.0]), (2, 0, 0.5, [1.0, 0.0]), (2, 1, 0.5, [0.0, 1.0]), (2, 2, 1.0, [0.0, 3.0]), (3, 0, 1.0, [1.0, 0.0]), (3, 1, 1.0, [-1.0, 0.0]), (3, 2, 0.0, [0.0, 0.0])], schema)
    assert [r["track"] for r in fusion.fuse(s).collect()] == [2]  # 1 has too few, 3 vanishes
    plain = fusion.fuse(s, renormalise=False).first()
    assert plain["vector"] == pytest.approx([0.25, 1.75]) and plain["mean_weight"] == pytest.approx(2 / 3)
    assert fusion.fuse(s, "median", renormalise=False).where("track = 2").first()["vector"] == [0.0, 1.0]
    assert {r["track"]: r["vector"] for r in fusion.moving_average(s, alpha=1.0).collect()} == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [-1.0, 0.0]}
    even = spark.createDataFrame([(1, k, 1.0, [float(k), 1.0]) for k in range(4)], schema)
    assert fusion.median(even, renormalise=False).first()["vector"] == [1.5, 1.0]
    assert fusion.fuse(s.limit(0)).count() == 0


def test_gallery_skips_what_cannot_be_compared(spark):
    g = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", None), (2, "c", [0.0, 1.0, 0.0]), (3, None, [0.0, 1.0]), (4, "d", [float("nan"), 1.0]), (None, "e", [1.0, 0.0])], "entry_index bigint, identity string, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, None), (10, [1.0]), (7, [0.0, 1.0])], "query_id bigint, vector array<double>")
    hits = gallery.top_hits(q.where("vector is not null").dropDuplicates(["query_id"]), g)
    assert {(r["query_id"], r["rank"], r["entry_index"]) for r in hits.where("query_id = 8").collect()} == {(8, 1, 3), (8, 2, 0)}
    d = {r["query_id"]: r["reason"] for r in gallery.decide(gallery.best_and_margin(gallery.top_hits(q.where("query_id > 7"), g), q.where("query_id > 7")), 0.5).collect()}
    assert d == {8: "no_hit", 9: "no_hit", 10: "no_hit"}  # the nearest entry has no identity
    assert gallery.calibrated_threshold(g.limit(0)).first()["threshold"] == gallery.THRESHOLD
    assert [r["identity"] for r in gallery.identities(g).collect()] == ["a", "b", "c", "d", "e"]


def test_quantile_of_impostors(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = spark.createDataFrame([(k, f"p{k // 2}", x.tolist()) for k, x in enumerate(v)], "entry_index bigint, identity string, vector array<double>").repartition(3)
    pairs = np.round([v[i] @ v[j] for i in range(300) for j in range(i) if i // 2 != j // 2], 6)
    for share in (0.0, 0.37, 0.99, 0.999, 1.0):
        got = gallery.impostor_quantile(g, share, size=64).first()
        assert got["n_pairs"] == len(pairs) and got["quantile"] == pytest.approx(np.quantile(pairs, share), abs=2e-6) and got["largest"] == pytest.approx(pairs.max())


def test_identify_reports_every_track(spark):
    g = spark.createDataFrame([(k, f"p{k // 2}", [1.0, 0.1 * k]) for k in range(8)], "entry_index bigint, identity string, vector array<double>")
    t = spark.createDataFrame([(1, [1.0, 0.0], 0.9), (2, [1.0, 0.0], 0.2), (3, [1.0, 0.0], None), (4, [-1.0, 0.0], 1.0)], "query_id bigint, vector array<double>, coherence double")
    got = {r["query_id"]: r for r in gallery.identify(t, g, 0.5).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {1: "ambiguous", 2: "incoherent", 3: "incoherent", 4: "below_threshold"}
    assert len(got[4]["candidates"]) == 5 and got[2]["candidates"] is None and got[2]["similarity"] == 0
    assert {r["reason"] for r in gallery.identify(t, g.limit(0), 0.5).collect()} == {"incoherent", "no_hit"}


def test_consent_fails_closed(spark):
    g = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0])], "entry_index bigint, identity string, vector array<double>")
    c = spark.createDataFrame([("a", "signed", datetime.date(2030, 1, 1))], "identity string, basis string, expires_on date")
    today = F.lit("2024-06-01").cast("date")
    with pytest.raises(PermissionError, match="b"):
        gallery.verified(g, c, today)
    with pytest.raises(PermissionError):
        gallery.verified(g, None, today)
    assert gallery.verified(g, None, today, waived=True).count() == 2 and gallery.verified(g.where("identity = 'a'"), c, today).count() == 1
    blank = enrolment.consent_template(g)
    assert [r["identity"] for r in blank.collect()] == ["a", "b"] and gallery.consent_gaps(g, blank.withColumn("expires_on", F.lit(None).cast("date")), today).count() == 2


def test_audit_round_trip(spark, tmp_path):
    path = "file://" + str(tmp_path / "audit")
    assert governance.read_audit(spark, path).count() == 0
    d = spark.createDataFrame([(1, "a", 0.9123456789, None, True, "accepted"), (2, None, 0.1, 0.01, False, "below_threshold")], "query_id bigint, identity string, similarity double, margin double, accepted boolean, reason string")
    for day in ("2024-06-01", "2024-06-02"):
        governance.append_audit(governance.audit_rows(d), path, F.lit(day).cast("date"))
    (tmp_path / "audit" / "day=2024-06-02" / "part-blank.json").write_text("\n\n")
    back = governance.read_audit(spark, path)
    assert back.count() == 4 and {(r["identity"], r["similarity"]) for r in back.collect()} == {("a", 0.912346), ("UNKNOWN", 0.1)}
    governance.save_manifest(governance.manifest(d), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["n_identified"] == 1


def test_enrolment_discovery_and_first_reason(spark, tmp_path):
    for name in ("bob/2.jpg", "bob/1.PNG", "alice/x.jpeg", "alice/.hidden.jpg", "alice/notes.txt", ".cache/a.jpg", "empty/readme.md", "stray.jpg", "alice/deep/er/y.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = [(r["identity"], r["source"].rsplit("/", 1)[1]) for r in enrolment.discover(spark, str(tmp_path)).collect()]
    assert got == [("alice", "x.jpeg"), ("bob", "1.PNG"), ("bob", "2.jpg")]
    with pytest.raises(FileNotFoundError):
        enrolment.discover(spark, str(tmp_path / "empty"))
    rows = [(False, 0, 90.0, ["blur"], 0.1), (True, 0, 90.0, ["blur"], 0.1), (True, 3, 90.0, ["blur"], 0.1), (True, 1, -90.0, ["blur"], 0.1), (True, 1, 45.0, ["blur", "truncation"], 0.1), (True, 1, 0.0, [], 0.1), (True, 1, 0.0, [], 0.9), (None, 1, 0.0, [], 0.9), (True, 1, None, [], 0.9)]
    d = spark.createDataFrame(rows, "readable boolean, n_faces int, roll double, reasons array<string>, score double")
    assert [r[0] for r in d.select(enrolment.refusal(0.5)).collect()] == ["unreadable", "no_face", "many_faces", "roll", "gate: blur; truncation", "low_quality", None, "unreadable", "roll"]


def test_adaptive_threshold_in_chunks(spark):
    r = np.random.default_rng(1)
    rows = [(s, k, None if k % 50 == 7 else float(x), bool(k % 9)) for s in (1, 2) for k, x in enumerate(r.normal(28, 4, 900))]
    d = spark.createDataFrame(rows, "stream_id bigint, seq bigint, norm double, norm_calibrated boolean")
    got = {(x["stream_id"], x["seq"]): x["threshold"] for x in quality_gate.adaptive_threshold(d, ring=100, warmup=20, floor=5.0, chunk=130).collect()}
    for s in (1, 2):
        past = []
        for _, k, x, ok in (q for q in rows if q[0] == s):
            if not ok:
                assert (s, k) not in got
                continue
            seen = [y for y in past[-100:] if y is not None]
            want = max(np.quantile(seen, 0.35), 5.0) if len(past[-100:]) >= 20 else 5.0
            assert got[s, k] == pytest.approx(want)
            past.append(x)
    assert quality_gate.adaptive_threshold(d.limit(0)).count() == 0


def test_checks(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0, 0.5, 0.5), (2, 0.0, 0.0, 0.0, 5.0, 1.5, None), (3, None, 0.0, 1.0, 1.0, float("nan"), 0.1)], "id bigint, x1 double, y1 double, x2 double, y2 double, score double, quality double")
    assert {r["id"]: r["broken"] for r in checks.quarantined(d, ["box", "score", "quality"]).collect()} == {2: ["box", "score", "quality"], 3: ["box", "score"]}
    assert checks.checked(d.limit(1), ["box", "score"]).count() == 1
    with pytest.raises(Exception, match="a row breaks: box, score"):
        checks.checked(d, ["box", "score"]).collect()
    with pytest.raises(ValueError):
        checks.consistent(d, 4)
    with pytest.raises(Exception, match="bad vector"):
        gallery_table.checked(spark.createDataFrame([(0, "a", [1.0, 0.0], "x")], gallery_table.SCHEMA), dim=3).collect()


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "stage string, duration_ms double, items bigint")
    assert reports.stage_report(none).count() == 0
    r = reports.run_report(none, 0, 0.0).first()
    assert (r["fps"], r["ms_per_frame"], r["accounted_ms"], r["unaccounted_ms"]) == (0.0, 0.0, 0.0, 0.0)
    assert reports.combined_rate(spark.createDataFrame([("a", 0.0, 0)], "detector string, total_ms double, frames bigint")).first()[0] == 0.0
    one = spark.createDataFrame([("b", 1.0, 0), ("a", 5.0, None), ("c", 5.0, 2)], none.schema)
    assert [(x["stage"], x["ms_per_item"]) for x in reports.stage_report(one).collect()] == [("a", 5.0), ("c", 2.5), ("b", 1.0)]


def test_scaled_template_and_measurement(spark):
    assert np.allclose(align.scaled_template(112, 112), align.TEMPLATE)
    b = Box(*[F.lit(x) for x in (1.0, 2.0, 1.0, 2.0)])
    u = spark.range(1).select(*b.measurement(), *b.clip_loose(1, 1)).first()
    assert tuple(u) == (1.0, 2.0, 1.0, 1e-6, 0.0, 0.0, 1.0, 1.0)


def test_tracks_in_segments_equal_tracks_in_one(spark):
    """A stream is cut where no track can have survived."""
    r = np.random.default_rng(2)
    rows = []
    for s in (1, 2):
        f = 0
        for part in range(6):
            for k in range(12):
                rows += [(s, f + k, d, 60.0 * d + 3 * k, 100.0 + part, 60.0 * d + 3 * k + 40, 180.0 + part, float(r.uniform(0.05, 1))) for d in range(4) if r.random() < 0.9]
            f += 12 + int(r.choice([5, 31, 32, 33, 200]))
    d = spark.createDataFrame(rows, BOXES)
    want = pd.concat([tracker.run_frames(tracker.Tracker(s), pd.DataFrame([x for x in rows if x[0] == s], columns=d.columns)) for s in (1, 2)])
    got = tracker.track(d.repartition(5)).toPandas()
    key = ["stream_id", "frame_number", "track_id"]
    want, got = (x.sort_values(key).reset_index(drop=True) for x in (want, got))
    pd.testing.assert_frame_equal(want, got, check_dtype=False)
    assert len(got) > 100 and tracker.track(d.limit(0)).count() == 0


def test_cells_find_nearly_all_hits(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(300, 32))
    v = centres[np.arange(3000) % 300] + r.normal(0, 0.6, (3000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    schema = "entry_index bigint, identity string, vector array<double>"
    g = spark.createDataFrame([(k, f"p{k % 300}", x.tolist()) for k, x in enumerate(v)] + [(5000, "x", None), (5001, "y", [1.0])], schema)
    q = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v[::30])] + [(900, None)], "query_id bigint, vector array<double>")
    pairs = lambda d: {(x["query_id"], x["entry_index"]) for x in d.collect()}
    exact = pairs(gallery.top_hits(q, g))
    found = gallery.cell_hits(q, g, least=1000)
    assert len(pairs(found) & exact) >= 0.95 * len(exact) and found.count() == len(exact) == 500
    assert pairs(gallery.cell_hits(q, g)) == exact  # below the least number of entries


def test_assignment_parts_equal_the_whole():
    r = np.random.default_rng(4)
    for _ in range(200):
        rows, cols = r.integers(1, 7, 2)
        weight = {(i, j): float(r.integers(1, 50)) for i in range(rows) for j in range(cols) if r.random() < 0.4}
        got = assign.best_pairs(list(weight), weight)
        m = np.zeros((rows, cols))
        for e, w in weight.items():
            m[e] = -w
        best = -sum(m[i, j] for i, j in assign.assignment(m))
        assert sum(weight[e] for e in got) == pytest.approx(best) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
