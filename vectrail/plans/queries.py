"""The registered queries over the derived tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.functions.geometry import box, clock, distance, roll_degrees
from vectrail.operators import align, assign, detections, frames, fusion, gallery, governance, lifecycle, quality_gate, reports, tracker
from vectrail.plans import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


@query(f"""WITH {X.FRAMES}, d AS (SELECT *, pts - lag(pts) OVER (PARTITION BY stream_id ORDER BY pts, packet_index) AS d FROM frames),
g AS (SELECT stream_id, count(*) AS n_frames, min(pts) AS first_pts, max(pts) AS last_pts, count(DISTINCT d) AS n_steps, min(d) AS min_step, max(d) AS max_step, avg(d) AS m, stddev_pop(d) AS s FROM d GROUP BY stream_id)
SELECT stream_id, n_frames, first_pts, last_pts, last_pts - first_pts AS span, n_steps, min_step, max_step, round(m, 4) AS mean_step, round(s, 4) AS std_step, n_steps > 1 AS is_vfr, round(CASE WHEN m > 0 THEN 1 / (m * 0.000001::DOUBLE) ELSE 0 END, 6) AS fps FROM g""")
def timing_report(spark, sf):
    return frames.timing_report(X.frames(spark, sf))


@query(f"""WITH {X.FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pts, packet_index) - 1 AS n FROM frames WHERE pts >= 86400000000 AND pts <= 1728000000000)
SELECT stream_id, pts, packet_index, key_frame, n // 3 AS frame_number FROM n WHERE n % 3 = 0 AND n // 3 < 10""")
def frames_strided(spark, sf):
    return frames.sample(X.frames(spark, sf), stride=3, max_frames=10, start=86_400_000_000, end=1_728_000_000_000)


@query(f"""WITH {X.FRAMES}, a AS (SELECT stream_id, pts, xor(packet_index, 1) AS packet_index, key_frame FROM frames), b AS (SELECT *, lag(pts) OVER (PARTITION BY stream_id ORDER BY packet_index) AS previous FROM a) SELECT * FROM b WHERE pts <= previous""")
def non_monotonic(spark, sf):
    return frames.out_of_order(X.frames(spark, sf).withColumn("packet_index", F.col("packet_index").bitwiseXOR(F.lit(1).cast("bigint"))).select("stream_id", "pts", "packet_index", "key_frame"))


@query(f"""WITH {X.FRAMES} SELECT stream_id, packet_index, CASE WHEN pts // 3600000000 < 100 THEN lpad((pts // 3600000000)::VARCHAR, 2, '0') ELSE (pts // 3600000000)::VARCHAR END || ':' || lpad(((pts // 60000000) % 60)::VARCHAR, 2, '0') || ':' || lpad(((pts // 1000000) % 60)::VARCHAR, 2, '0') || '.' || lpad(((pts // 1000) % 1000)::VARCHAR, 3, '0') AS clock FROM frames""")
def timestamp_string(spark, sf):
    return X.frames(spark, sf).select("stream_id", "packet_index", clock(F.col("pts")).alias("clock"))


@query(f"""WITH {X.BOXES}, c AS (SELECT *, least(greatest(x1, 0), 319) AS cx1, least(greatest(y1, 0), 239) AS cy1 FROM boxes)
SELECT stream_id, frame_number, det, w * h AS area, round(w / h, 6) AS aspect, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, cx1, cy1, least(greatest(x2, cx1 + 1), 320) AS cx2, least(greatest(y2, cy1 + 1), 240) AS cy2, round(1 - (greatest(least(x2, 320) - greatest(x1, 0), 0) * greatest(least(y2, 240) - greatest(y1, 0), 0)) / (w * h), 6) + 0 AS truncation, round_even(x1 / 2, 0) AS half_x FROM c""")
def box_geometry(spark, sf):
    b, rows = box(), X.boxes(spark, sf)
    c = b.clip(320, 240)
    return rows.select("stream_id", "frame_number", "det", b.area.alias("area"), F.round(b.width / b.height, 6).alias("aspect"), F.round(b.centre[0], 6).alias("cx"), F.round(b.centre[1], 6).alias("cy"), c.x1.alias("cx1"), c.y1.alias("cy1"), c.x2.alias("cx2"), c.y2.alias("cy2"), (F.round(b.truncation(320, 240), 6) + 0.0).alias("truncation"), F.bround(F.col("x1") / 2, 0).alias("half_x"))


INTER = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"


@query(f"""WITH {X.BOXES}, p AS (SELECT a.stream_id, a.frame_number, a.det AS a_det, b.det AS b_det, {INTER} AS inter, a.w * a.h AS aa, b.w * b.h AS ba FROM boxes a JOIN boxes b ON a.stream_id = b.stream_id AND a.frame_number = b.frame_number AND a.det < b.det)
SELECT stream_id, frame_number, a_det, b_det, round(inter / (aa + ba - inter) + 0.000000001::DOUBLE, 6) AS iou FROM p WHERE inter > 0""")
def pair_iou(spark, sf):
    return detections.overlapping(X.boxes(spark, sf)).withColumn("iou", F.round(F.col("iou") + 1e-9, 6))


@query(f"""WITH {X.BOXES} SELECT stream_id, frame_number, det, score, CASE WHEN score >= 0.35 THEN 'high' ELSE 'low' END AS band FROM boxes WHERE score >= 0.10""")
def confidence_bands(spark, sf):
    return X.boxes(spark, sf).select("stream_id", "frame_number", "det", "score", detections.band(F.col("score")).alias("band")).where("band is not null")


@query(f"""WITH {X.BOXES} SELECT stream_id, frame_number, det, w, h FROM boxes WHERE w * h >= 4096 AND least(w, h) >= 48""")
def min_size_filter(spark, sf):
    return X.boxes(spark, sf).where(detections.large_enough(box(), 4096, 48)).select("stream_id", "frame_number", "det", "w", "h")


def _face_pairs(spark, sf):
    return detections.face_pairs(X.boxes(spark, sf), X.faces(spark, sf)).select("stream_id", "frame_number", "det", "face", "inside", "cost")


FINTER = "(greatest(least(b.x2, f.fx2) - greatest(b.x1, f.fx1), 0) * greatest(least(b.y2, f.fy2) - greatest(b.y1, f.fy1), 0))"


@query(f"""WITH {X.FACES}, p AS (SELECT b.stream_id, b.frame_number, b.det, f.face, {FINTER} / ((f.fx2 - f.fx1) * (f.fy2 - f.fy1)) AS inside, least(greatest(abs((f.fx1 + f.fx2) / 2 - (b.x1 + b.x2) / 2) / ((b.x2 - b.x1) / 2 + 0.000001::DOUBLE), 0), 1) AS off, ((f.fx2 - f.fx1) * (f.fy2 - f.fy1) + 0.000001::DOUBLE) / ((b.x2 - b.x1) * (b.y2 - b.y1) + 0.000001::DOUBLE) AS ratio, (f.fy1 + f.fy2) / 2 <= b.y1 + (b.y2 - b.y1) * 0.45::DOUBLE AS head FROM faces f JOIN boxes b ON b.stream_id = f.stream_id AND b.frame_number = f.frame_number)
SELECT stream_id, frame_number, det, face, round(inside + 0.000000001::DOUBLE, 6) AS inside, round(0.000000001::DOUBLE + CASE WHEN inside >= 0.6 AND head THEN 0.5 * (1 - inside) + 0.3::DOUBLE * off + 0.2::DOUBLE * least(greatest(abs(log2(ratio / 0.035::DOUBLE)) / 3, 0), 1) END, 6) AS cost FROM p""")
def pair_containment_cost(spark, sf):
    p = _face_pairs(spark, sf)
    return p.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("inside", "cost")})


@query()
def assignments(spark, sf):
    feasible = _face_pairs(spark, sf).where("cost is not null")
    return rounded(assign.assign_groups(feasible, ["stream_id", "frame_number"], "det", "face", "cost"), "cost", "score")


# boxes are taken by score; each joins the list of those that stay unless it overlaps one of them too much
@query(f"""WITH RECURSIVE {X.BOXES}, r AS (SELECT stream_id, frame_number, det, x1, y1, x2, y2, score, row_number() OVER (PARTITION BY stream_id, frame_number ORDER BY score DESC, det) AS n FROM boxes),
s AS (SELECT stream_id, frame_number, n, [{{'det': det, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM r WHERE n = 1
 UNION ALL SELECT r.stream_id, r.frame_number, r.n, CASE WHEN len(list_filter(s.kept, lambda k: greatest(least(k.x2, r.x2) - greatest(k.x1, r.x1), 0) * greatest(least(k.y2, r.y2) - greatest(k.y1, r.y1), 0) > 0.55::DOUBLE * ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(least(k.x2, r.x2) - greatest(k.x1, r.x1), 0) * greatest(least(k.y2, r.y2) - greatest(k.y1, r.y1), 0)))) > 0 THEN s.kept ELSE list_append(s.kept, {{'det': r.det, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
 FROM s JOIN r ON r.stream_id = s.stream_id AND r.frame_number = s.frame_number AND r.n = s.n + 1),
last AS (SELECT stream_id, frame_number, arg_max(kept, n) AS kept FROM s GROUP BY stream_id, frame_number),
u AS (SELECT stream_id, frame_number, unnest(kept).det AS det FROM last)
SELECT r.stream_id, r.frame_number, r.det, x1, y1, x2, y2, score FROM r JOIN u ON u.stream_id = r.stream_id AND u.frame_number = r.frame_number AND u.det = r.det""")
def suppressed_boxes(spark, sf):
    return assign.suppress(X.boxes(spark, sf).select("stream_id", "frame_number", "det", "x1", "y1", "x2", "y2", "score"), ["stream_id", "frame_number"])


@query(f"""WITH {X.FACES} SELECT stream_id, frame_number, face, round(sqrt((rx - lx) ** 2 + (ry - ly) ** 2), 6) AS eye_distance, round(degrees(atan2(ry - ly, rx - lx)), 6) + 0 AS roll, abs(degrees(atan2(ry - ly, rx - lx))) <= 5 AS upright FROM faces""")
def landmark_pose(spark, sf):
    points = [F.col(c) for c in ("lx", "ly", "rx", "ry")]
    roll = roll_degrees(*points)
    return X.faces(spark, sf).select("stream_id", "frame_number", "face", F.round(distance(*points), 6).alias("eye_distance"), (F.round(roll, 6) + 0.0).alias("roll"), detections.upright(roll, 5.0).alias("upright"))


def _umeyama_sql() -> str:
    p = ["l", "r", "n", "a", "b"]
    name = lambda k, c: f'"{p[k]}{c}"'
    ux, uy = (sum(t[k] for t in align.TEMPLATE) / 5 for k in (0, 1))
    d = lambda x: f"{x!r}::DOUBLE"
    mean = lambda c: "((" + " + ".join(name(k, c) for k in range(5)) + ") / 5)"
    sums = lambda f: " + ".join(f(f"({name(k, 'x')} - mx)", f"({name(k, 'y')} - my)", d(align.TEMPLATE[k][0] - ux), d(align.TEMPLATE[k][1] - uy)) for k in range(5))
    err = sums(lambda x, y, u, v: f"(a * {x} - b * {y} - {u}) ** 2 + (b * {x} + a * {y} - {v}) ** 2")
    return f"""WITH {X.FACES}, m AS (SELECT *, {mean("x")} AS mx, {mean("y")} AS my FROM faces),
s AS (SELECT *, {sums(lambda x, y, u, v: f"{x} * {u} + {y} * {v}")} AS sa, {sums(lambda x, y, u, v: f"{x} * {v} - {y} * {u}")} AS sb, {sums(lambda x, y, u, v: f"{x} * {x} + {y} * {y}")} AS sd FROM m),
t AS (SELECT *, sa / sd AS a, sb / sd AS b FROM s)
SELECT stream_id, frame_number, face, round(sqrt(a * a + b * b), 6) AS scale, round(degrees(atan2(b, a)), 6) + 0 AS rotation, round(sqrt(({err}) / 5), 6) AS residual, round(a / (a * a + b * b), 6) AS ia, round(-b / (a * a + b * b), 6) + 0 AS ib, round(-(a * ({ux!r}::DOUBLE - a * mx + b * my) + b * ({uy!r}::DOUBLE - b * mx - a * my)) / (a * a + b * b), 4) + 0 AS itx, round((b * ({ux!r}::DOUBLE - a * mx + b * my) - a * ({uy!r}::DOUBLE - b * mx - a * my)) / (a * a + b * b), 4) + 0 AS ity FROM t"""


@query(_umeyama_sql())
def umeyama_fit(spark, sf):
    p = ["l", "r", "n", "a", "b"]
    fit = align.similarity([F.col(f"{k}x") for k in p], [F.col(f"{k}y") for k in p])
    rows = X.faces(spark, sf).select("stream_id", "frame_number", "face", *[fit[k].alias(f"fit_{k}") for k in fit])
    inv = align.inverse(*[F.col(f"fit_{k}") for k in ("a", "b", "tx", "ty")])
    out = rows.select("stream_id", "frame_number", "face", F.col("fit_scale").alias("scale"), F.col("fit_rotation").alias("rotation"), F.col("fit_residual").alias("residual"), *[inv[c].alias(c) for c in ("ia", "ib", "itx", "ity")])
    return rounded(rounded(out, "scale", "rotation", "residual", "ia", "ib"), "itx", "ity", digits=4)


BLUR = "(45 / greatest(scale, 1) ** 2)"
SCORE = f"0.3::DOUBLE * CASE WHEN norm_calibrated THEN least(greatest((norm - 18) / 30, 0), 1) ELSE 0.5 END + 0.2::DOUBLE * least(greatest(sharpness / (4 * {BLUR} + 0.000001::DOUBLE), 0), 1) + 0.2::DOUBLE * least(greatest((eye_distance - 20) / 40, 0), 1) + 0.1::DOUBLE * least(greatest(1 - abs(brightness - 130) / 105, 0), 1) + 0.1::DOUBLE * least(greatest(1 - truncation, 0), 1) + 0.1::DOUBLE * least(greatest(detection_score, 0), 1)"


@query(f"""WITH {X.QUALITY} SELECT stream_id, seq, round({SCORE}, 6) AS score, array_to_string(list_filter([CASE WHEN detection_score < 0.6::DOUBLE THEN 'detector' END, CASE WHEN sharpness < {BLUR} THEN 'blur' END, CASE WHEN brightness < 25 OR brightness > 235 THEN 'illumination' END, CASE WHEN truncation > 0.1::DOUBLE THEN 'truncation' END, CASE WHEN eye_distance < 20 THEN 'eye_distance' END, CASE WHEN norm_calibrated AND norm < 18 THEN 'norm_low' END, CASE WHEN norm_calibrated AND norm > 48 THEN 'norm_high' END], lambda x: x IS NOT NULL), ',') AS reasons FROM q""")
def quality_gate_rows(spark, sf):
    return X.quality_rows(spark, sf).select("stream_id", "seq", F.round(quality_gate.score(), 6).alias("score"), F.array_join(quality_gate.reasons(), ",").alias("reasons"))


@query(f"""WITH {X.QUALITY}, w AS (SELECT stream_id, seq, norm, quantile_cont(norm, 0.35) OVER r AS p, count(*) OVER r AS n FROM q WHERE norm_calibrated WINDOW r AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 512 PRECEDING AND 1 PRECEDING))
SELECT stream_id, seq, round(CASE WHEN n >= 64 THEN greatest(p, 18) ELSE 18 END, 6) AS threshold, norm < CASE WHEN n >= 64 THEN greatest(p, 18) ELSE 18 END AS low FROM w""")
def adaptive_threshold(spark, sf):
    rows = quality_gate.adaptive_threshold(X.quality_rows(spark, sf))
    return rows.select("stream_id", "seq", F.round("threshold", 6).alias("threshold"), (F.col("norm") < F.col("threshold")).alias("low"))


def _vector_rows(fused: DataFrame) -> DataFrame:
    return fused.select("track", F.posexplode("vector").alias("dim", "x")).select("track", F.col("dim").cast("bigint").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


def _fused_sql(expr: str, source: str = "kept", extra: str = "") -> str:
    return f"""WITH {X.SAMPLES}{extra}, d AS (SELECT track, seq, weight, unnest(range(len(vector))) AS dim, unnest(vector) AS x FROM {source}), f AS (SELECT track, dim, {expr} AS x FROM d GROUP BY track, dim), n AS (SELECT track, sqrt(sum(x * x)) AS n FROM f GROUP BY track) SELECT f.track, f.dim, round(f.x / n.n, 6) + 0 AS x FROM f JOIN n ON n.track = f.track"""


@query(_fused_sql("sum(x * weight) / sum(weight)"))
def fuse_weighted_mean(spark, sf):
    return _vector_rows(fusion.weighted_mean(X.samples(spark, sf)))


@query(_fused_sql("quantile_cont(x, 0.5)"))
def fuse_median(spark, sf):
    return _vector_rows(fusion.median(X.samples(spark, sf)))


@query(_fused_sql("sum(x * share)", "shares", ", shares AS (SELECT track, seq, vector, weight, coalesce(exp(sum(ln(1 - 0.3::DOUBLE * weight)) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) * CASE WHEN row_number() OVER (PARTITION BY track ORDER BY seq) = 1 THEN 1 ELSE 0.3::DOUBLE * weight END AS share FROM samples)").replace("SELECT track, seq, weight, unnest", "SELECT track, seq, share, unnest"))
def fuse_ema(spark, sf):
    return _vector_rows(fusion.moving_average(X.samples(spark, sf)))


@query(f"""WITH {X.SAMPLES}, p AS (SELECT a.track, avg(list_dot_product(a.vector, b.vector)) AS c FROM kept a JOIN kept b ON a.track = b.track AND a.seq <> b.seq GROUP BY a.track) SELECT k.track, count(*) AS n_samples, round(avg(weight), 6) AS mean_weight, round(coalesce(any_value(c), 1), 6) AS coherence FROM kept k LEFT JOIN p ON p.track = k.track GROUP BY k.track""")
def coherence(spark, sf):
    return rounded(fusion.coherence(X.samples(spark, sf)), "mean_weight", "coherence")


@query(f"""WITH {X.SAMPLES}, n AS (SELECT track, seq, row_number() OVER (PARTITION BY track ORDER BY seq) AS n_samples FROM samples) SELECT track, seq, n_samples FROM n WHERE n_samples BETWEEN 3 AND 32 AND (n_samples - 3) % 5 = 0""")
def decision_points(spark, sf):
    return fusion.decision_points(X.samples(spark, sf)).select("track", "seq", F.col("n_samples").cast("bigint").alias("n_samples"))


def _hits(spark, sf):
    return gallery.top_hits(X.probes(spark, sf), X.gallery(spark, sf))


@query(f"WITH {X.SEARCH} SELECT query_id, rank, entry_index, identity, round(similarity, 6) AS similarity FROM hits")
def knn_top5(spark, sf):
    return rounded(_hits(spark, sf), "similarity").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {X.SEARCH}, {X.BEST} SELECT query_id, identity, round(similarity, 6) AS similarity, round(margin, 6) AS margin FROM best")
def margin_distinct_identity(spark, sf):
    return rounded(gallery.best_and_margin(_hits(spark, sf)).select("query_id", "identity", "similarity", "margin"), "similarity", "margin")


@query(f"WITH {X.SEARCH}, {X.IMPOSTORS} SELECT count(*) AS n_pairs, round(avg(similarity), 5) + 0 AS mean, round(quantile_cont(similarity, 0.99), 5) AS p99, round(max(similarity), 5) AS largest FROM impostors")
def impostor_stats(spark, sf):
    i = gallery.impostor_quantile(X.gallery(spark, sf), 0.99).withColumnRenamed("quantile", "p99")
    return rounded(i, "mean", "p99", "largest", digits=5)


@query(f"WITH {X.SEARCH}, {X.IMPOSTORS} SELECT n_pairs, round(quantile, 5) AS quantile, round(threshold, 5) AS threshold FROM threshold")
def calibrated_threshold(spark, sf):
    return rounded(gallery.calibrated_threshold(X.gallery(spark, sf)), "quantile", "threshold", digits=5)


def _decisions(spark, sf):
    one = gallery.calibrated_threshold(X.gallery(spark, sf)).select("threshold")
    best = gallery.best_and_margin(_hits(spark, sf)).join(F.broadcast(one))  # one row
    return gallery.decide(best, F.col("threshold"))


@query(f"WITH {X.SEARCH}, {X.IMPOSTORS}, {X.BEST}, {X.DECIDE} SELECT query_id, identity, round(similarity, 6) AS similarity, round(margin, 6) AS margin, reason = 'accepted' AS accepted, reason FROM decisions")
def open_set_decisions(spark, sf):
    return rounded(_decisions(spark, sf), "similarity", "margin").select("query_id", "identity", "similarity", "margin", "accepted", "reason")


@query(f"WITH {X.SEARCH}, {X.IMPOSTORS}, {X.BEST}, {X.DECIDE} SELECT query_id, CASE WHEN reason = 'accepted' THEN identity ELSE 'UNKNOWN' END AS identity, round(similarity, 6) AS similarity, round(margin, 6) AS margin, reason = 'accepted' AS accepted, reason FROM decisions")
def audit_rows(spark, sf):
    return governance.audit_rows(_decisions(spark, sf))


@query(f"WITH {X.SEARCH}, {X.IMPOSTORS}, {X.BEST}, {X.DECIDE} SELECT count(*) AS n_decided, count(*) FILTER (WHERE reason = 'accepted') AS n_identified, count(*) FILTER (WHERE reason <> 'accepted') AS n_unknown, round(count(*) FILTER (WHERE reason = 'accepted') / count(*), 6) AS acceptance_rate FROM decisions")
def manifest_counts(spark, sf):
    return governance.manifest(_decisions(spark, sf))


@query(f"WITH {X.SEARCH}, {X.IMPOSTORS}, {X.BEST}, {X.DECIDE} SELECT query_id, CASE WHEN reason = 'accepted' THEN identity END AS identity, CASE WHEN reason = 'accepted' THEN round(similarity, 6) END AS similarity, reason <> 'accepted' AS redacted FROM decisions")
def redacted_export(spark, sf):
    d = rounded(_decisions(spark, sf), "similarity").select("query_id", "identity", "similarity", "accepted")
    return governance.redact(d, F.col("accepted"), ["identity", "similarity"]).drop("accepted")


def _consent(spark, sf):
    ids = X.gallery(spark, sf).select("identity").distinct().withColumn("n", F.expr("cast(substring(identity, 4) as bigint)"))
    return ids.where("n % 10 <> 0").select("identity", F.expr("if(n % 7 = 0, ' ', 'contract')").alias("basis"), F.expr("if(n % 11 = 0, date'2023-01-01', date'2030-01-01')").alias("expires_on"))


@query("WITH ids AS (SELECT DISTINCT vec_id // 3 AS n FROM embeddings WHERE vec_id % 5 <> 0) SELECT 'id_' || n AS identity FROM ids WHERE n % 10 = 0 OR n % 7 = 0 OR n % 11 = 0")
def consent_gaps(spark, sf):
    return gallery.consent_gaps(X.gallery(spark, sf), _consent(spark, sf), F.lit("2024-06-01").cast("date"))


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention_filter(spark, sf):
    e = X.read(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    return governance.within_retention(e.join(F.broadcast(now)), "ts", F.col("now"), 10).select("event_id", "user_id")  # one row


@query("""WITH q AS (SELECT event_type AS stage, value, 1 + event_id % 4 AS items FROM events) SELECT stage, count(*) AS calls, sum(items)::BIGINT AS items, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, max(value) AS max_ms, round(sum(value) / sum(items), 6) AS ms_per_item FROM q GROUP BY stage""")
def stage_latency(spark, sf):
    q = X.read(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"), (1 + F.col("event_id") % 4).alias("items"))
    return rounded(rounded(reports.stage_report(q), "mean_ms", "p50_ms", "p95_ms", "p99_ms", "ms_per_item"), "total_ms", digits=4)


@query(f"""WITH {X.BOXES}, o AS (SELECT stream_id, frame_number, det, avg(score) OVER w AS m, row_number() OVER (PARTITION BY stream_id, det ORDER BY frame_number) AS hits FROM boxes WINDOW w AS (PARTITION BY stream_id, det ORDER BY frame_number ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)) SELECT stream_id, frame_number, det, round(least(greatest(0.5 * m + 0.2::DOUBLE * least(hits / 3, 1) + 0.3::DOUBLE, 0), 1) + 0.000000001::DOUBLE, 6) AS confidence FROM o""")
def track_confidence(spark, sf):
    w = W.partitionBy("stream_id", "det").orderBy("frame_number")
    c = lifecycle.confidence(F.avg("score").over(w.rowsBetween(1 - lifecycle.SCORES, 0)), F.row_number().over(w), F.lit(0))
    return X.boxes(spark, sf).select("stream_id", "frame_number", "det", F.round(c + 1e-9, 6).alias("confidence"))


@query()
def tracks_batch(spark, sf):
    return rounded(tracker.track(X.boxes(spark, sf)), "x1", "y1", "x2", "y2", "confidence")
