"""More registered queries: the frame flow, decisions on tracks, enrolment, checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.functions.geometry import box, declared_variable, direction_consistency, from_cxcywh, from_measurement, from_xywh, roll_degrees, seconds
from vectrail.operators import align, detections, enrolment, frames, fusion, gallery, governance, quality_gate, reports
from vectrail.plans import fixtures as X
from vectrail.plans.queries import BLUR, FINTER, SCORE, query, rounded
from vectrail.sources import checks

FRAME = ["stream_id", "frame_number"]
REASONS = "[CASE WHEN detection_score < 0.6::DOUBLE THEN 'detector' END, CASE WHEN sharpness < {blur} THEN 'blur' END, CASE WHEN brightness < 25 OR brightness > 235 THEN 'illumination' END, CASE WHEN truncation > 0.1::DOUBLE THEN 'truncation' END, CASE WHEN eye_distance < 20 THEN 'eye_distance' END, CASE WHEN norm_calibrated AND norm < {limit} THEN 'norm_low' END, CASE WHEN norm_calibrated AND norm > 48 THEN 'norm_high' END]"


@query(f"""WITH {X.BOXES} SELECT stream_id, frame_number, det, x1 + w AS far_x, y1 + h AS far_y, (x1 + x2) / 2 - w / 2 AS near_x, least(greatest(x1, 0), 319) AS lx1, least(greatest(y1, 0), 239) AS ly1, least(greatest(x2, 1), 320) AS lx2, least(greatest(y2, 1), 240) AS ly2, (x1 - 10) / 0.5 AS ux1, (y2 - 20) / 0.5 AS uy2, round_even((x1 + x2) / 2, 0)::BIGINT AS rx, round((x1 + x2) / 2 - sqrt(w * h * (w / h)) / 2, 6) + 0 AS mx1 FROM boxes""")
def box_conversions(spark, sf):
    b = box()
    a, c, loose, back = from_xywh(*b.xywh()), from_cxcywh(*b.cxcywh()), b.clip_loose(320, 240), b.unletterbox(0.5, 10, 20)
    again = from_measurement(*b.measurement())
    middle = from_cxcywh(*b.centre, b.width, b.height)
    return X.boxes(spark, sf).select(*FRAME, "det", a.x2.alias("far_x"), a.y2.alias("far_y"), c.x1.alias("near_x"), loose.x1.alias("lx1"), loose.y1.alias("ly1"), loose.x2.alias("lx2"), loose.y2.alias("ly2"), back.x1.alias("ux1"), back.y2.alias("uy2"), F.bround(middle.centre[0], 0).cast("bigint").alias("rx"), (F.round(again.x1, 6) + 0.0).alias("mx1"))


@query(f"""WITH {X.FRAMES} SELECT stream_id, packet_index, round(pts * 1 / 1000000::DOUBLE, 6) AS seconds, CASE WHEN packet_index % 7 <> 0 THEN round(pts * 1 / 1000000::DOUBLE, 6) END AS decode_seconds, coalesce(CASE WHEN packet_index % 5 <> 0 THEN stream_id % 3 END <> packet_index % 3, false) AS variable FROM frames""")
def frame_seconds(spark, sf):
    dts = F.when(F.col("packet_index") % 7 != 0, F.col("pts"))
    rate = F.when(F.col("packet_index") % 5 != 0, F.col("stream_id") % 3)
    return X.frames(spark, sf).select("stream_id", "packet_index", F.round(seconds(F.col("pts")), 6).alias("seconds"), F.round(seconds(dts), 6).alias("decode_seconds"), declared_variable(rate, F.col("packet_index") % 3).alias("variable"))


@query("WITH b AS (SELECT n, (n // 8) * 46500 + [0, 3000, 6000, 9000, 15000, 26250, 37500, 43500][(n % 8 + 1)::INTEGER] AS p FROM range(100) AS t(n)), k AS (SELECT min(n) AS k FROM b WHERE p >= 180000), s AS (SELECT k, 90000 - (SELECT p FROM b WHERE n = k + 1) + (SELECT p FROM b WHERE n = k) AS shift FROM k), f AS (SELECT n, p + CASE WHEN n > k THEN shift ELSE 0 END AS pts FROM b, s) SELECT n AS frame_number, pts FROM f WHERE n <= (SELECT min(n) FROM f WHERE pts >= 360000)")
def frame_schedule(spark, sf):
    return frames.schedule(spark, "gap", gap=1.0)


@query(f"""WITH {X.FRAMES}, f AS (SELECT stream_id, packet_index, CASE WHEN packet_index % 9 <> 0 THEN pts END AS pts FROM (SELECT stream_id, pts, xor(packet_index, 1) AS packet_index FROM frames)),
l AS (SELECT *, last_value(pts IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
n AS (SELECT stream_id, count(*) AS n_decoded, count(*) FILTER (WHERE pts IS NULL) AS n_dropped, count(*) FILTER (WHERE pts <= before) AS n_out_of_order FROM l GROUP BY stream_id)
SELECT *, (n_decoded - n_dropped + 2) // 3 AS n_emitted FROM n""")
def frame_counts(spark, sf):
    f = X.frames(spark, sf).withColumn("packet_index", F.col("packet_index").bitwiseXOR(F.lit(1).cast("bigint"))).withColumn("pts", F.when(F.col("packet_index") % 9 != 0, F.col("pts")))
    return frames.counts(f, frames.sample(f, stride=3))


@query(f"""WITH {X.BOXES}, p AS (SELECT stream_id, det, frame_number, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM boxes WHERE det <= 2)
SELECT stream_id, det, frame_number, count(*) OVER w AS n_points, first_value(cx) OVER w AS start_x, round(sum(cy) OVER w, 3) AS sum_y FROM p WINDOW w AS (PARTITION BY stream_id, det ORDER BY frame_number ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)""")
def trajectories(spark, sf):
    b = box()
    rows = X.boxes(spark, sf).where("det <= 2").select("stream_id", "det", F.struct("stream_id", "det").alias("track"), "frame_number", b.centre[0].alias("cx"), b.centre[1].alias("cy"))
    t = frames.trajectory(rows)
    return t.select("stream_id", "det", "frame_number", F.size("path").cast("bigint").alias("n_points"), F.get("path", F.lit(0))["cx"].alias("start_x"), F.round(F.aggregate("path", F.lit(0.0), lambda s, p: s + p["cy"]), 3).alias("sum_y"))


@query(f"""WITH {X.BOXES}, k AS (SELECT *, least(greatest(score * 1.25::DOUBLE, 0), 1) AS s FROM boxes WHERE part % 3 IN (0, 1)), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_number ORDER BY s DESC, det) AS n FROM k WHERE s >= 0.35) SELECT stream_id, frame_number, det, s AS score FROM r WHERE n <= 3 AND w * h >= 4096""")
def selected_detections(spark, sf):
    rows = X.boxes(spark, sf).withColumn("class_id", F.col("part") % 3).withColumn("score", F.col("score") * 1.25)
    return detections.select_detections(rows, [0, 1], min_area=4096, max_iou=None, most=3).select(*FRAME, "det", "score")


@query(f"""WITH {X.FACES} SELECT stream_id, frame_number, face, round(degrees(atan2(ry - ly, rx - lx)), 6) + 0 AS roll FROM faces WHERE face % 7 <> 1 AND least(fx2 - fx1, fy2 - fy1) >= 40 AND abs(degrees(atan2(ry - ly, rx - lx))) <= 3""")
def selected_faces(spark, sf):
    points = ["lx", "ly", "rx", "ry", "nx", "ny", "ax", "ay", "bx", "by"]
    f = X.faces(spark, sf).withColumn("lx", F.when(F.col("face") % 7 != 1, F.col("lx")))  # some without landmarks
    roll = roll_degrees(*[F.col(c) for c in points[:4]])
    kept = f.where(detections.has_landmarks([F.col(c) for c in points]) & detections.face_large_enough(box("f"), 40) & detections.upright(roll, 3.0))
    return kept.select(*FRAME, "face", (F.round(roll, 6) + 0.0).alias("roll"))


# a face belongs to the body that it was made for, where the pair is feasible and cheap enough
ASSIGNED = f"""p AS (SELECT b.stream_id, b.frame_number, b.det, f.face, {FINTER} / ((f.fx2 - f.fx1) * (f.fy2 - f.fy1)) AS inside, least(greatest(abs((f.fx1 + f.fx2) / 2 - (b.x1 + b.x2) / 2) / ((b.x2 - b.x1) / 2 + 0.000001::DOUBLE), 0), 1) AS off, ((f.fx2 - f.fx1) * (f.fy2 - f.fy1) + 0.000001::DOUBLE) / ((b.x2 - b.x1) * (b.y2 - b.y1) + 0.000001::DOUBLE) AS ratio, (f.fy1 + f.fy2) / 2 <= b.y1 + (b.y2 - b.y1) * 0.45::DOUBLE AS head FROM faces f JOIN boxes b ON b.stream_id = f.stream_id AND b.frame_number = f.frame_number AND b.det = f.face),
assigned AS (SELECT stream_id, frame_number, det, face, 't' || stream_id || '_' || det AS track FROM p WHERE inside >= 0.6 AND head AND 0.5 * (1 - inside) + 0.3::DOUBLE * off + 0.2::DOUBLE * least(greatest(abs(log2(ratio / 0.035::DOUBLE)) / 3, 0), 1) <= 0.65)"""


def _assigned(spark, sf):
    p = detections.face_pairs(X.boxes(spark, sf), X.faces(spark, sf)).where("det = face and cost <= 0.65D")
    return p.select(*FRAME, "det", "face", F.concat(F.lit("t"), F.col("stream_id").cast("string"), F.lit("_"), F.col("det").cast("string")).alias("track"))


@query(f"""WITH {X.FACES}, {ASSIGNED} SELECT f.stream_id, f.frame_number, f.face FROM faces f ANTI JOIN assigned a ON a.stream_id = f.stream_id AND a.frame_number = f.frame_number AND a.face = f.face""")
def faces_without_body(spark, sf):
    return detections.unassigned(X.faces(spark, sf), _assigned(spark, sf), [*FRAME, "face"]).select(*FRAME, "face")


@query(f"""WITH {X.FACES}, {ASSIGNED} SELECT b.stream_id, b.frame_number, b.det FROM boxes b ANTI JOIN assigned a ON a.stream_id = b.stream_id AND a.frame_number = b.frame_number AND a.det = b.det""")
def bodies_without_face(spark, sf):
    return detections.unassigned(X.boxes(spark, sf), _assigned(spark, sf), [*FRAME, "det"]).select(*FRAME, "det")


@query(f"""WITH {X.FACES}, b AS (SELECT stream_id, frame_number, count(*) AS n_bodies FROM boxes WHERE score >= 0.35 GROUP BY ALL), f AS (SELECT stream_id, frame_number, count(*) AS n_faces FROM faces WHERE fx2 - fx1 >= 60 GROUP BY ALL) SELECT stream_id, frame_number, coalesce(n_bodies, 0) AS n_bodies, coalesce(n_faces, 0) AS n_faces FROM b FULL JOIN f USING (stream_id, frame_number)""")
def combined_detections(spark, sf):
    return detections.combined(X.boxes(spark, sf).where(F.col("score") >= 0.35), X.faces(spark, sf).where("fx2 - fx1 >= 60"))


TRACK_DECISIONS = "decided AS (SELECT 't' || stream_id || '_' || det AS track, frame_number AS seq, 'id_' || (part % 40) AS identity, score AS similarity, score >= 0.5 AS accepted FROM boxes WHERE frame_number % 5 = 0), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY seq DESC) AS n FROM decided) WHERE n = 1)"


def _track_decisions(spark, sf):
    b = X.boxes(spark, sf).where("frame_number % 5 = 0")
    return b.select(F.concat(F.lit("t"), F.col("stream_id").cast("string"), F.lit("_"), F.col("det").cast("string")).alias("track"), F.col("frame_number").alias("seq"), F.concat(F.lit("id_"), (F.col("part") % 40).cast("string")).alias("identity"), F.col("score").alias("similarity"), (F.col("score") >= 0.5).alias("accepted"))


@query(f"WITH {X.BOXES}, {TRACK_DECISIONS} SELECT track, seq, identity, similarity, accepted FROM latest")
def latest_decisions(spark, sf):
    return governance.latest(_track_decisions(spark, sf))


@query(f"""WITH {X.FACES}, {ASSIGNED}, {TRACK_DECISIONS} SELECT f.stream_id, f.frame_number, f.face, CASE WHEN a.track IS NULL THEN 'unassigned' ELSE 'not_accepted' END AS why FROM faces f LEFT JOIN assigned a ON a.stream_id = f.stream_id AND a.frame_number = f.frame_number AND a.face = f.face LEFT JOIN latest l ON l.track = a.track AND l.accepted WHERE l.track IS NULL""")
def redacted_faces(spark, sf):
    targets = detections.redaction_targets(X.faces(spark, sf), _assigned(spark, sf), governance.latest(_track_decisions(spark, sf)))
    return targets.select(*FRAME, "face", "why")


@query(f"""WITH {X.BOXES}, {TRACK_DECISIONS}, t AS (SELECT 't' || stream_id || '_' || det AS track, max(score) AS confidence FROM boxes GROUP BY ALL)
SELECT t.track, '#' || t.track[1:8] || ' ' || CASE WHEN l.track IS NULL THEN 'unresolved' WHEN accepted THEN identity || ' ' || printf('%.2f', similarity) ELSE 'UNKNOWN' END || ' conf ' || printf('%.2f', confidence) AS label FROM t LEFT JOIN latest l ON l.track = t.track""")
def track_labels(spark, sf):
    b = X.boxes(spark, sf).select(F.concat(F.lit("t"), F.col("stream_id").cast("string"), F.lit("_"), F.col("det").cast("string")).alias("track"), "score")
    t = b.groupBy("track").agg(F.max("score").alias("confidence")).join(governance.latest(_track_decisions(spark, sf)).withColumn("decided", F.lit(True)), "track", "left")
    return t.select("track", detections.label(F.col("track"), F.col("decided"), F.col("accepted"), F.col("identity"), F.col("similarity"), F.col("confidence")).alias("label"))


@query(f"""WITH {X.BOXES} SELECT CASE WHEN score >= 0.35 THEN 'confirmed' WHEN score >= 0.10 THEN 'tentative' ELSE 'lost' END AS state, count(DISTINCT stream_id || '_' || det) AS n_tracks FROM boxes WHERE frame_number % 100 = 0 GROUP BY state""")
def track_population(spark, sf):
    state = F.coalesce(F.element_at(F.create_map(F.lit("high"), F.lit("confirmed"), F.lit("low"), F.lit("tentative")), F.coalesce(detections.band(F.col("score")), F.lit(""))), F.lit("lost"))
    return governance.population(X.boxes(spark, sf).where("frame_number % 100 = 0").select(state.alias("state"), F.concat_ws("_", "stream_id", "det").alias("track_id")))


@query(f"""WITH {X.BOXES}, p AS (SELECT stream_id, det, frame_number, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM boxes), l AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(cx, 2) OVER w AS qx, lag(cy, 2) OVER w AS qy FROM p WINDOW w AS (PARTITION BY stream_id, det ORDER BY frame_number)),
h AS (SELECT *, sqrt((px - qx) ** 2 + (py - qy) ** 2) AS n FROM l WHERE qx IS NOT NULL), u AS (SELECT *, CASE WHEN n > 0.000001 THEN (px - qx) / n ELSE 0 END AS hx, CASE WHEN n > 0.000001 THEN (py - qy) / n ELSE 0 END AS hy FROM h)
SELECT stream_id, det, frame_number, round(CASE WHEN hx = 0 AND hy = 0 THEN 0.5 ELSE (least(greatest(((cx - px) * hx + (cy - py) * hy) / (sqrt((cx - px) ** 2 + (cy - py) ** 2) + 0.000001::DOUBLE), -1), 1) + 1) / 2 END, 5) AS consistency FROM u""")
def heading_consistency(spark, sf):
    w = W.partitionBy("stream_id", "det").orderBy("frame_number")
    cx, cy = box().centre
    p = X.boxes(spark, sf).select("stream_id", "det", "frame_number", cx.alias("cx"), cy.alias("cy"))
    p = p.withColumns({"px": F.lag("cx").over(w), "py": F.lag("cy").over(w), "qx": F.lag("cx", 2).over(w), "qy": F.lag("cy", 2).over(w)}).where("qx is not null")
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    n = F.sqrt(dx * dx + dy * dy)
    unit = lambda d: F.when(n > 1e-6, d / n).otherwise(0.0)
    c = direction_consistency(F.col("px"), F.col("py"), F.col("cx"), F.col("cy"), unit(dx), unit(dy))
    return p.select("stream_id", "det", "frame_number", F.round(c, 5).alias("consistency"))


@query(f"""WITH {X.QUALITY}, w AS (SELECT stream_id, seq, quantile_cont(norm, 0.35) OVER r AS p, count(*) OVER r AS n FROM q WHERE norm_calibrated WINDOW r AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 512 PRECEDING AND 1 PRECEDING)),
g AS (SELECT q.*, CASE WHEN n >= 64 THEN greatest(p, 18) WHEN n IS NOT NULL THEN 18 END AS lim FROM q LEFT JOIN w ON w.stream_id = q.stream_id AND w.seq = q.seq),
a AS (SELECT *, list_filter({REASONS.format(blur=BLUR, limit="coalesce(lim, 18)")}, lambda x: x IS NOT NULL) AS reasons FROM g)
SELECT stream_id, seq, round({SCORE}, 6) AS score, round(lim, 6) AS norm_threshold, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM a""")
def quality_gated(spark, sf):
    g = quality_gate.gated(X.quality_rows(spark, sf))
    return rounded(g, "score", "norm_threshold").select("stream_id", "seq", "score", "norm_threshold", F.array_join("reasons", ",").alias("reasons"), "passed")


@query(f"""WITH {X.QUALITY}, a AS (SELECT len(list_filter({REASONS.format(blur=BLUR, limit="18")}, lambda x: x IS NOT NULL)) = 0 AS passed FROM q) SELECT count(*) AS n_assessed, count(*) FILTER (WHERE passed) AS n_passed, round(count(*) FILTER (WHERE passed) / count(*), 6) AS pass_rate FROM a""")
def gate_report(spark, sf):
    return rounded(quality_gate.gate_report(quality_gate.assess(X.quality_rows(spark, sf))), "pass_rate")


# one in seven images unreadable, some with no or many faces
IMAGES = f"images AS (SELECT *, 'id_' || (seq % 40) AS identity, seq % 7 <> 3 AS readable, CASE WHEN seq % 11 = 5 THEN 0 WHEN seq % 13 = 4 THEN 2 ELSE 1 END AS n_faces, ((seq * 7) % 120 - 60)::DOUBLE AS roll, {SCORE} AS score, list_filter({REASONS.format(blur=BLUR, limit='18')}, lambda x: x IS NOT NULL) AS reasons FROM q), refused AS (SELECT *, CASE WHEN NOT readable THEN 'unreadable' WHEN n_faces = 0 THEN 'no_face' WHEN n_faces > 1 THEN 'many_faces' WHEN abs(roll) > 45 THEN 'roll' WHEN len(reasons) > 0 THEN 'gate: ' || array_to_string(reasons, '; ') WHEN score < 0.6::DOUBLE THEN 'low_quality' END AS reason FROM images)"


def _images(spark, sf):
    q = quality_gate.assess(X.quality_rows(spark, sf))
    n = F.when(F.col("seq") % 11 == 5, 0).when(F.col("seq") % 13 == 4, 2).otherwise(1)
    q = q.withColumns({"identity": F.concat(F.lit("id_"), (F.col("seq") % 40).cast("string")), "readable": F.col("seq") % 7 != 3, "n_faces": n, "roll": ((F.col("seq") * 7) % 120 - 60).cast("double")})
    return q.withColumn("reason", enrolment.refusal(0.6))


@query(f"WITH {X.QUALITY}, {IMAGES} SELECT seq, identity, reason FROM refused")
def enrolment_refusals(spark, sf):
    return _images(spark, sf).select("seq", "identity", "reason")


@query(f"WITH {X.QUALITY}, {IMAGES}, g AS (SELECT identity, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected, round(avg(score) FILTER (WHERE reason IS NULL), 6) AS mean_quality FROM refused GROUP BY identity) SELECT *, CASE WHEN accepted = 0 THEN 'none enrolled' WHEN accepted = 1 THEN 'single reference' END AS warning FROM g")
def enrolment_report(spark, sf):
    return rounded(enrolment.report(_images(spark, sf)), "mean_quality")


@query(f"WITH {X.SEARCH} SELECT DISTINCT identity, '' AS basis, '' AS obtained_on, '' AS expires_on FROM gallery ORDER BY identity")
def consent_template(spark, sf):
    return enrolment.consent_template(X.gallery(spark, sf))


@query("""WITH d AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'body' ELSE 'face' END AS detector, sum(value) AS total_ms, count(*) AS frames FROM events GROUP BY ALL) SELECT round(1000 / sum(total_ms / frames), 6) AS combined_fps FROM d""")
def combined_rate(spark, sf):
    e = X.read(spark, sf, "events").groupBy(F.when(F.col("event_type").isin("view", "click"), "body").otherwise("face").alias("detector")).agg(F.sum("value").alias("total_ms"), F.count("*").alias("frames"))
    return rounded(reports.combined_rate(e), "combined_fps")


@query("""SELECT 1000::BIGINT AS frames, 5000000::DOUBLE AS elapsed_ms, round(1000.0 * 1000 / 5000000, 6)::DOUBLE AS fps, 5000::DOUBLE AS ms_per_frame, round(sum(value), 4) AS accounted_ms, round(greatest(5000000 - sum(value), 0), 4) AS unaccounted_ms FROM events""")
def run_report(spark, sf):
    calls = X.read(spark, sf, "events").select(F.col("value").alias("duration_ms"))
    return rounded(reports.run_report(calls, 1000, 5_000_000.0), "accounted_ms", "unaccounted_ms", digits=4)


@query(" UNION ALL ".join(f"SELECT {k}::BIGINT AS point, round(80 + ({x!r}::DOUBLE * 160 / 112 - 80) / 1.25, 6) AS x, round(100 + ({y!r}::DOUBLE * 200 / 112 - 100) / 1.25, 6) AS y" for k, (x, y) in enumerate(align.TEMPLATE)))
def scaled_template(spark, sf):
    rows = [(k, x, y) for k, (x, y) in enumerate(align.scaled_template(160, 200, 0.25))]
    return rounded(spark.createDataFrame(rows, "point bigint, x double, y double"), "x", "y")


# tracks of which some have too few samples
FEW = "few AS (SELECT * FROM samples WHERE track % 5 <> 2 OR seq < 2)"


def _few(spark, sf):
    return X.samples(spark, sf).where("track % 5 <> 2 or seq < 2")


@query(f"WITH {X.SAMPLES}, {FEW}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY seq DESC) AS r FROM few) WHERE r <= 32) SELECT track, count(*) AS n_samples, round(avg(weight), 6) AS mean_weight FROM k GROUP BY track HAVING count(*) >= 3")
def fused_tracks(spark, sf):
    return rounded(fusion.fuse(_few(spark, sf)), "mean_weight").select("track", "n_samples", "mean_weight")


@query(f"WITH {X.SAMPLES}, {FEW} SELECT track FROM few WHERE track NOT IN (SELECT track FROM samples WHERE track % 3 = 0) GROUP BY track HAVING count(*) >= 3")
def undecided_tracks(spark, sf):
    decided = X.samples(spark, sf).where("track % 3 = 0").select("track")
    return governance.undecided(fusion.ready_tracks(_few(spark, sf)), decided)


@query(f"""WITH {X.SAMPLES}, r AS (SELECT track, seq, vector, CASE WHEN seq % 4 = 1 THEN 1 ELSE weight END AS a, max(CASE WHEN seq % 4 = 1 OR weight >= 1 THEN seq END) OVER (PARTITION BY track) AS again FROM samples),
shares AS (SELECT track, seq, vector, coalesce(exp(sum(ln(CASE WHEN a < 1 THEN 1 - a END)) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) * CASE WHEN seq = again THEN 1 ELSE a END AS share FROM r WHERE again IS NULL OR seq >= again),
d AS (SELECT track, seq, share, unnest(range(len(vector))) AS dim, unnest(vector) AS x FROM shares), f AS (SELECT track, dim, sum(x * share) AS x FROM d GROUP BY track, dim), n AS (SELECT track, sqrt(sum(x * x)) AS n FROM f GROUP BY track) SELECT f.track, f.dim, round(f.x / n.n, 6) + 0 AS x FROM f JOIN n ON n.track = f.track""")
def fuse_ema_restart(spark, sf):
    s = X.samples(spark, sf).withColumn("weight", F.when(F.col("seq") % 4 == 1, 1.0).otherwise(F.col("weight")))
    v = fusion.moving_average(s, alpha=1.0)
    return v.select("track", F.posexplode("vector").alias("dim", "x")).select("track", F.col("dim").cast("bigint").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


TRACK_SEARCH = f"""{X.SAMPLES}, {FEW}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY seq DESC) AS r FROM few) WHERE r <= 32),
c0 AS (SELECT a.track, avg(list_dot_product(a.vector, b.vector)) AS c FROM k a JOIN k b ON a.track = b.track AND a.seq <> b.seq GROUP BY a.track),
d AS (SELECT track, seq, weight, unnest(range(len(vector))) AS dim, unnest(vector) AS x FROM k), f AS (SELECT track, dim, sum(x * weight) / sum(weight) AS x FROM d GROUP BY track, dim HAVING count(*) >= 3), n AS (SELECT track, sqrt(sum(x * x)) AS n, list(x ORDER BY dim) AS v FROM f GROUP BY track),
t AS (SELECT n.track AS query_id, list_transform(v, lambda x: x / n) AS vector, c AS coherence FROM n JOIN c0 ON c0.track = n.track),
g AS (SELECT vec_id AS entry_index, 'id_' || (vec_id // 3) AS identity, v AS vector FROM e WHERE vec_id % 5 <> 0),
ranked AS (SELECT query_id, entry_index, identity, list_dot_product(t.vector, g.vector) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(t.vector, g.vector) DESC, entry_index) AS rank FROM t, g WHERE coherence >= 0.7),
hits AS (SELECT * FROM ranked WHERE rank <= 5), tops AS (SELECT query_id, max(identity) FILTER (WHERE rank = 1) AS identity, max(similarity) AS similarity, string_agg(entry_index, ',' ORDER BY rank) AS candidates FROM hits GROUP BY query_id),
best AS (SELECT t.query_id, t.identity, t.similarity, candidates, t.similarity - max(h.similarity) FILTER (WHERE h.identity <> t.identity) AS margin FROM tops t JOIN hits h ON h.query_id = t.query_id GROUP BY t.query_id, t.identity, t.similarity, candidates)"""


@query(f"""WITH {TRACK_SEARCH} SELECT t.query_id, identity, round(CASE WHEN coherence < 0.7 THEN 0 ELSE similarity END, 6) AS similarity, round(CASE WHEN coherence < 0.7 THEN 0 ELSE margin END, 6) AS margin, CASE WHEN coherence < 0.7 THEN 'incoherent' WHEN similarity < 0.9 THEN 'below_threshold' WHEN margin < 0.05 THEN 'ambiguous' ELSE 'accepted' END AS reason, candidates FROM t LEFT JOIN best b ON b.query_id = t.query_id""")
def track_decisions(spark, sf):
    few = _few(spark, sf)
    tracks = fusion.fuse(few).join(fusion.coherence(few).select("track", "coherence"), "track").withColumnRenamed("track", "query_id")
    out = gallery.identify(tracks.select("query_id", "vector", "coherence"), X.gallery(spark, sf), 0.9)
    entries = F.array_join(F.transform("candidates", lambda c: c["entry_index"].cast("string")), ",")
    return rounded(out, "similarity", "margin").select("query_id", "identity", "similarity", "margin", "reason", entries.alias("candidates"))


@query("SELECT vec_id AS query_id, NULL::VARCHAR AS identity, NULL::DOUBLE AS similarity, NULL::DOUBLE AS margin, false AS accepted, 'no_hit' AS reason FROM embeddings")
def empty_gallery_decisions(spark, sf):
    probes = X.probes(spark, sf)
    best = gallery.best_and_margin(gallery.top_hits(probes, X.gallery(spark, sf).where(F.lit(False))), probes)
    return gallery.decide(best, 0.35).select("query_id", "identity", "similarity", "margin", "accepted", "reason")


@query(f"""WITH {X.SEARCH}, ids AS (SELECT DISTINCT identity, substring(identity, 4)::BIGINT AS n FROM gallery), ok AS (SELECT identity FROM ids WHERE n % 10 <> 0 AND n % 7 <> 0 AND n % 11 <> 0),
r AS (SELECT query_id, entry_index, g.identity, list_dot_product(p.vector, g.vector) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(p.vector, g.vector) DESC, entry_index) AS rank FROM probes p, gallery g WHERE g.identity IN (SELECT identity FROM ok)) SELECT query_id, rank, entry_index, identity, round(similarity, 6) AS similarity FROM r WHERE rank <= 5""")
def consented_top5(spark, sf):
    from vectrail.plans.queries import _consent

    hits = gallery.consented_hits(X.probes(spark, sf), X.gallery(spark, sf), _consent(spark, sf), F.lit("2024-06-01").cast("date"))
    return rounded(hits, "similarity").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH {X.BOXES}, b AS (SELECT *, CASE WHEN part % 17 = 0 THEN x1 ELSE x2 END AS xx, CASE WHEN det % 6 = 0 THEN score + 1 ELSE score END AS s, CASE WHEN part % 19 <> 0 THEN w / 200 END AS quality FROM boxes), r AS (SELECT *, list_filter([CASE WHEN NOT (xx > x1 AND y2 > y1) THEN 'box' END, CASE WHEN NOT (s >= 0 AND s <= 1) THEN 'score' END, CASE WHEN NOT coalesce(quality >= 0 AND quality <= 1, false) THEN 'quality' END], lambda x: x IS NOT NULL) AS broken FROM b)
SELECT stream_id, frame_number, det, array_to_string(broken, ',') AS broken FROM r WHERE len(broken) > 0""")
def quarantined_rows(spark, sf):
    b = X.boxes(spark, sf)
    b = b.withColumns({"x2": F.when(F.col("part") % 17 == 0, F.col("x1")).otherwise(F.col("x2")), "score": F.when(F.col("det") % 6 == 0, F.col("score") + 1).otherwise(F.col("score")), "quality": F.when(F.col("part") % 19 != 0, F.col("w") / 200)})
    return checks.quarantined(b, ["box", "score", "quality"]).select(*FRAME, "det", F.array_join("broken", ",").alias("broken"))
