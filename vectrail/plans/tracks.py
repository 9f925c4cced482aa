"""Registered queries over single tracks: motion, headings, lives and decisions as they grow.

A track here is all boxes of one number in a stream, one a frame at most.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.functions.geometry import box
from vectrail.operators import counted, frames, governance, lifecycle, motion, progress, quality_gate
from vectrail.plans import fixtures as X
from vectrail.plans.queries import query, rounded
from vectrail.sources import frame_files
from vectrail.sources.shared import fresh_path

KEYS = ("stream_id", "det")
D = "::DOUBLE"


def _motion_sql() -> str:
    """Frame gaps are stepped over by the sums of their single steps, as in the operator."""
    noise = {"u": ("1", "1", "0.01"), "v": ("1", "1", "0.01"), "s": ("10", "1", "0.0001")}
    z = ("u", "v", "s")
    seed = ", ".join(f"z{a} AS {a}x, 0{D} AS {a}d, 10{D} AS {a}a, 0{D} AS {a}b, 10000{D} AS {a}c" for a in z)
    value = {"u": "ux + k * ud AS ux, ud", "v": "vx + k * vd AS vx, vd", "s": "sx + steps * sd AS sx, CASE WHEN steps < k THEN 0 ELSE sd END AS sd"}
    cov = {a: f"{a}a + 2 * k * {a}b + k * k * {a}c + k * {q}{D} + {qd}{D} * ((k - 1) * k * (2 * k - 1) / 6) AS {a}a, {a}b + k * {a}c + {qd}{D} * (k * (k - 1) / 2) AS {a}b, {a}c + k * {qd}{D} AS {a}c" for a, (_, q, qd) in noise.items()}
    later = ", ".join(f"{value[a]}, {cov[a]}" for a in z)
    fix = ", ".join(f"{a}x + {a}a / ({a}a + {r}{D}) * (z{a} - {a}x) AS {a}x, {a}d + {a}b / ({a}a + {r}{D}) * (z{a} - {a}x) AS {a}d, (1 - {a}a / ({a}a + {r}{D})) * {a}a AS {a}a, (1 - {a}a / ({a}a + {r}{D})) * {a}b AS {a}b, {a}c - {a}b / ({a}a + {r}{D}) * {a}b AS {a}c" for a, (r, *_) in noise.items())
    return f"""WITH RECURSIVE {X.BOXES}, z AS (SELECT stream_id, det, frame_number, row_number() OVER (PARTITION BY stream_id, det ORDER BY frame_number) AS n, (x1 + x2) / 2 AS zu, (y1 + y2) / 2 AS zv, greatest(w * h, 1){D} AS zs, greatest(w / h, 0.000001){D} AS zr FROM boxes),
m AS (SELECT stream_id, det, n, frame_number, {seed}, zr AS ratio, 10{D} AS p FROM z WHERE n = 1
 UNION ALL SELECT stream_id, det, n, frame_number, {fix}, ratio + p / (p + 10) * (zr - ratio) AS ratio, p * (1 - p / (p + 10)) AS p
 FROM (SELECT stream_id, det, n, frame_number, zu, zv, zs, zr, {later}, ratio, p + k * 1 AS p
 FROM (SELECT *, CASE WHEN sx + sd > 0 THEN least(k, CASE WHEN sd < 0 THEN ceil(sx / -sd) - 1 ELSE k END) ELSE 0 END AS steps
 FROM (SELECT z.*, m.* EXCLUDE (stream_id, det, n, frame_number), (z.frame_number - m.frame_number){D} AS k FROM m JOIN z ON z.stream_id = m.stream_id AND z.det = m.det AND z.n = m.n + 1)))),
b AS (SELECT *, greatest(sx, 1) AS area, sqrt(greatest(sx, 1) * greatest(ratio, 0.000001{D})) AS w FROM m)
SELECT stream_id, det, frame_number, round(ux - w / 2, 6) AS x1, round(vx - area / w / 2, 6) AS y1, round(ux + w / 2, 6) AS x2, round(vx + area / w / 2, 6) AS y2, round(ud, 6) + 0 AS du, round(vd, 6) + 0 AS dv, round(ua + va, 6) AS uncertainty FROM b"""


@query(_motion_sql())
def motion_filter(spark, sf):
    return rounded(motion.filtered(X.boxes(spark, sf), KEYS), "x1", "y1", "x2", "y2", "du", "dv", "uncertainty")


HEADINGS = """p AS (SELECT stream_id, det, frame_number, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM boxes WHERE frame_number % 7 <> 3),
e AS (SELECT *, coalesce(first_value({'f': frame_number, 'x': cx, 'y': cy}) OVER (PARTITION BY stream_id, det ORDER BY frame_number RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), first_value({'f': frame_number, 'x': cx, 'y': cy}) OVER (PARTITION BY stream_id, det ORDER BY frame_number RANGE BETWEEN 16 PRECEDING AND 1 PRECEDING)) AS e FROM p),
n AS (SELECT *, sqrt((cx - e.x) * (cx - e.x) + (cy - e.y) * (cy - e.y)) AS n FROM e),
h AS (SELECT stream_id, det, frame_number, cx, cy, e.f AS since, CASE WHEN n > 0.000001 THEN (cx - e.x) / n ELSE 0 END AS hx, CASE WHEN n > 0.000001 THEN (cy - e.y) / n ELSE 0 END AS hy FROM n)"""


def _seen(spark, sf):
    return X.boxes(spark, sf).where("frame_number % 7 <> 3")


@query(f"WITH {X.BOXES}, {HEADINGS} SELECT stream_id, det, frame_number, since, round(hx, 6) + 0 AS hx, round(hy, 6) + 0 AS hy FROM h")
def track_headings(spark, sf):
    return rounded(motion.headings(_seen(spark, sf), keys=KEYS), "hx", "hy").select(*KEYS, "frame_number", "since", "hx", "hy")


@query(f"""WITH {X.BOXES}, {HEADINGS}, l AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(hx) OVER w AS ax, lag(hy) OVER w AS ay FROM h WINDOW w AS (PARTITION BY stream_id, det ORDER BY frame_number))
SELECT stream_id, det, frame_number, round(CASE WHEN px IS NULL THEN NULL WHEN ax = 0 AND ay = 0 THEN 0.5 ELSE (least(greatest(((cx - px) * ax + (cy - py) * ay) / (sqrt((cx - px) ** 2 + (cy - py) ** 2) + 0.000001{D}), -1), 1) + 1) / 2 END, 5) AS consistency FROM l""")
def going_on(spark, sf):
    return rounded(motion.going_on(_seen(spark, sf), keys=KEYS), "consistency", digits=5).select(*KEYS, "frame_number", "consistency")


# runs of frames without a gap, stretches without one over 30, and the first run of a stretch with three hits
LIVES = """o AS (SELECT DISTINCT stream_id, det, frame_number FROM boxes WHERE (frame_number // 4) % 3 <> 1),
g AS (SELECT *, frame_number - lag(frame_number) OVER w - 1 AS gap, lead(frame_number) OVER w AS following FROM o WINDOW w AS (PARTITION BY stream_id, det ORDER BY frame_number)),
r AS (SELECT *, sum(CASE WHEN coalesce(gap, 1) >= 1 THEN 1 ELSE 0 END) OVER w AS run, sum(CASE WHEN coalesce(gap, 31) > 30 THEN 1 ELSE 0 END) OVER w AS stretch FROM g WINDOW w AS (PARTITION BY stream_id, det ORDER BY frame_number)),
n AS (SELECT stream_id, det, stretch, run, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT stream_id, det, stretch, min(run) AS first_long FROM n WHERE n >= 3 GROUP BY ALL),
s AS (SELECT r.*, CASE WHEN coalesce(gap, 1) >= 1 AND NOT coalesce(run > first_long, false) THEN 1 ELSE 0 END AS begins FROM r LEFT JOIN f ON f.stream_id = r.stream_id AND f.det = r.det AND f.stretch = r.stretch),
v AS (SELECT *, (sum(begins) OVER (PARTITION BY stream_id, det ORDER BY frame_number))::BIGINT AS life FROM s),
h AS (SELECT *, row_number() OVER w AS hits, min(frame_number) OVER (PARTITION BY stream_id, det, life) AS born, count(*) OVER (PARTITION BY stream_id, det, life ORDER BY frame_number RANGE BETWEEN 16 PRECEDING AND CURRENT ROW) AS remembered FROM v WINDOW w AS (PARTITION BY stream_id, det, life ORDER BY frame_number))"""


@query(f"""WITH {X.BOXES}, {LIVES}, x AS (SELECT *, CASE WHEN hits >= 3 THEN 31 ELSE 1 END AS most, unnest(range(1 + least(coalesce(following - frame_number - 1, 31), CASE WHEN hits >= 3 THEN 31 ELSE 1 END))) AS missed FROM h)
SELECT stream_id, det, life, frame_number + missed AS frame_number, CASE WHEN missed = 0 THEN CASE WHEN hits >= 3 THEN 'confirmed' ELSE 'tentative' END WHEN missed = most THEN 'removed' ELSE 'lost' END AS state, hits, missed, frame_number + missed - born AS age, remembered FROM x""")
def track_lives(spark, sf):
    return lifecycle.states(X.boxes(spark, sf).where("floor(frame_number / 4) % 3 <> 1"), KEYS)


@query(f"""WITH {X.BOXES}, {LIVES}, m AS (SELECT h.stream_id, h.det, h.frame_number, life, hits, avg(score) OVER (PARTITION BY h.stream_id, h.det, life ORDER BY h.frame_number ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS mean FROM h JOIN boxes b ON b.stream_id = h.stream_id AND b.det = h.det AND b.frame_number = h.frame_number)
SELECT stream_id, det, frame_number, life, round(mean + 0.000000001{D}, 6) AS mean_score, round(0.5 * mean + 0.2{D} * least(hits / 3, 1) + 0.3{D} + 0.000000001{D}, 6) AS confidence FROM m""")
def track_scores(spark, sf):
    s = lifecycle.scored(X.boxes(spark, sf).where("floor(frame_number / 4) % 3 <> 1"), KEYS)
    return s.select(*KEYS, "frame_number", "life", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean_score", "confidence")])


GROWING = f"""{X.SAMPLES}, few AS (SELECT * FROM samples WHERE track % 5 <> 2 OR seq < 2),
o AS (SELECT track, seq, weight, vector, row_number() OVER (PARTITION BY track ORDER BY seq) AS n FROM few),
p AS (SELECT track, seq AS pt, n AS n_samples FROM o WHERE n BETWEEN 3 AND 32 AND (n - 3) % 5 = 0),
k AS (SELECT p.track, p.pt, p.n_samples, o.seq, o.weight, o.vector FROM p JOIN o ON o.track = p.track AND o.n <= p.n_samples AND o.n > p.n_samples - 32),
c0 AS (SELECT a.track, a.pt, avg(list_dot_product(a.vector, b.vector)) AS c FROM k a JOIN k b ON a.track = b.track AND a.pt = b.pt AND a.seq <> b.seq GROUP BY ALL),
u AS (SELECT track, pt, n_samples, weight, unnest(range(len(vector))) AS dim, unnest(vector) AS x FROM k),
f AS (SELECT track, pt, n_samples, dim, sum(x * weight) / sum(weight) AS x FROM u GROUP BY ALL), v AS (SELECT track, pt, n_samples, sqrt(sum(x * x)) AS len, list(x ORDER BY dim) AS v FROM f GROUP BY ALL),
t AS (SELECT v.track, v.pt, n_samples, list_transform(v, lambda x: x / len) AS vector, c AS coherence FROM v JOIN c0 ON c0.track = v.track AND c0.pt = v.pt),
g AS (SELECT vec_id AS entry_index, 'id_' || (vec_id // 3) AS identity, v AS vector FROM e WHERE vec_id % 5 <> 0),
ranked AS (SELECT track, pt, entry_index, identity, list_dot_product(t.vector, g.vector) AS similarity, row_number() OVER (PARTITION BY track, pt ORDER BY list_dot_product(t.vector, g.vector) DESC, entry_index) AS rank FROM t, g WHERE coherence >= 0.7),
hits AS (SELECT * FROM ranked WHERE rank <= 5), tops AS (SELECT track, pt, max(identity) FILTER (WHERE rank = 1) AS identity, max(similarity) AS similarity FROM hits GROUP BY ALL),
best AS (SELECT t.track, t.pt, t.identity, t.similarity, t.similarity - max(h.similarity) FILTER (WHERE h.identity <> t.identity) AS margin FROM tops t JOIN hits h ON h.track = t.track AND h.pt = t.pt GROUP BY t.track, t.pt, t.identity, t.similarity),
decisions AS (SELECT t.track, t.pt AS seq, n_samples, round(coherence, 6) AS coherence, identity, round(CASE WHEN coherence < 0.7 THEN 0 ELSE similarity END, 6) AS similarity, round(CASE WHEN coherence < 0.7 THEN 0 ELSE margin END, 6) AS margin, CASE WHEN coherence < 0.7 THEN 'incoherent' WHEN similarity < 0.9 THEN 'below_threshold' WHEN margin < 0.05 THEN 'ambiguous' ELSE 'accepted' END AS reason FROM t LEFT JOIN best b ON b.track = t.track AND b.pt = t.pt)"""


def _decisions(spark, sf):
    few = X.samples(spark, sf).where("track % 5 <> 2 or seq < 2")
    return rounded(progress.decided(few, X.gallery(spark, sf), 0.9), "coherence", "similarity", "margin")


SHOWN = ("track", "seq", "n_samples", "coherence", "identity", "similarity", "margin", "reason")


@query(f"WITH {GROWING} SELECT * FROM decisions")
def decisions_as_tracks_grow(spark, sf):
    return _decisions(spark, sf).select(*SHOWN).withColumn("n_samples", F.col("n_samples").cast("bigint"))


@query(f"WITH {GROWING} SELECT * FROM (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY track ORDER BY n_samples DESC) = 1)")
def standing_decisions(spark, sf):
    return progress.standing(_decisions(spark, sf)).select(*SHOWN).withColumn("n_samples", F.col("n_samples").cast("bigint"))


@query(f"""WITH {GROWING} SELECT 'identification' AS event, track AS track_id, CASE WHEN reason = 'accepted' THEN identity ELSE 'UNKNOWN' END AS identity, similarity, coalesce(margin, 0) AS margin, 0.9{D} AS threshold, reason = 'accepted' AS accepted, seq AS frame_number, seq / 25{D} AS media_seconds, n_samples AS embeddings_fused, round(coherence, 4) AS coherence, CASE WHEN reason <> 'accepted' THEN reason END AS rejection_reason, false AS finalised, 'clip' AS source FROM decisions""")
def identification_log(spark, sf):
    log = governance.identifications(_decisions(spark, sf), F.lit(0.9), "clip", media_seconds=F.col("seq") / 25)
    return log.drop("timestamp_utc").withColumn("embeddings_fused", F.col("embeddings_fused").cast("bigint"))


@query(f"""WITH {X.SAMPLES}, o AS (SELECT track, seq, weight, vector, row_number() OVER (PARTITION BY track ORDER BY seq) AS n FROM samples), p AS (SELECT track, seq, n AS seen FROM o WHERE n >= 3 AND (n - 3) % 5 = 0),
k AS (SELECT p.track, p.seq, p.seen, o.n, o.weight, o.vector FROM p JOIN o ON o.track = p.track AND o.n <= p.seen AND o.n > p.seen - 32),
c AS (SELECT a.track, a.seen, avg(list_dot_product(a.vector, b.vector)) AS c FROM k a JOIN k b ON a.track = b.track AND a.seen = b.seen AND a.n <> b.n GROUP BY ALL),
u AS (SELECT track, seen, unnest(range(len(vector))) AS dim, unnest(vector) AS x FROM k), m AS (SELECT track, seen, dim, quantile_cont(x, 0.5) AS x FROM u GROUP BY ALL), l AS (SELECT track, seen, sum(x) / sqrt(sum(x * x)) AS total FROM m GROUP BY ALL)
SELECT k.track, k.seq, k.seen, count(*) AS n_samples, round(avg(weight), 6) AS mean_weight, round(any_value(c), 6) AS coherence, round(any_value(total), 6) + 0 AS total FROM k JOIN c ON c.track = k.track AND c.seen = k.seen JOIN l ON l.track = k.track AND l.seen = k.seen GROUP BY k.track, k.seq, k.seen""")
def fused_as_tracks_grow(spark, sf):
    p = progress.growing(X.samples(spark, sf), "median", count_all=True)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    out = p.select("track", "seq", F.col("seen").cast("bigint").alias("seen"), F.col("n_samples").cast("bigint").alias("n_samples"), "mean_weight", "coherence", total.alias("total"))
    return rounded(out, "mean_weight", "coherence", "total")


@query(f"""WITH {X.FRAMES}, {X.QUALITY}, {X.SAMPLES}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE packet_index % 19 = 0) AS dropped FROM frames), g AS (SELECT count(*) AS n, count(*) FILTER (WHERE detection_score >= 0.6::DOUBLE) AS sure, max(norm) AS most FROM q), s AS (SELECT count(*) AS n FROM (SELECT track FROM samples GROUP BY track HAVING count(*) >= 3))
SELECT 'decode' AS stage, 'rows' AS counter, n{D} AS value FROM a UNION ALL SELECT 'decode', 'dropped', dropped FROM a UNION ALL SELECT 'gate', 'rows', n FROM g UNION ALL SELECT 'gate', 'sure', sure FROM g UNION ALL SELECT 'gate', 'largest_norm', round(most, 6) FROM g UNION ALL SELECT 'fuse', 'rows', n FROM s""")
def stage_counters(spark, sf):
    c = counted.Counters()
    decoded = c.watch(X.frames(spark, sf).withColumn("pts", F.when(F.col("packet_index") % 19 != 0, F.col("pts"))), "decode", dropped=F.count_if(F.col("pts").isNull()))
    gated = c.watch(quality_gate.assess(X.quality_rows(spark, sf)), "gate", sure=F.count_if(F.col("detection_score") >= 0.6), largest_norm=F.max("norm"))
    fused = c.watch(progress.fusion.fuse(X.samples(spark, sf)), "fuse")
    for stage in (frames.timing_report(decoded), gated, fused):
        stage.write.format("noop").mode("overwrite").save()
    return rounded(c.rows(spark), "value")


@query(f"WITH {X.SAMPLES}, n AS (SELECT track, count(*) AS n FROM samples WHERE track % 5 <> 2 OR seq < 2 GROUP BY track) SELECT count(*) AS tracks, count(*) FILTER (WHERE n >= 3) AS ready, sum(least(n, 32))::BIGINT AS retained_samples, sum(n)::BIGINT AS total_seen FROM n")
def fusion_statistics(spark, sf):
    return counted.fusion_statistics(X.samples(spark, sf).where("track % 5 <> 2 or seq < 2"))


DAY = 86_400_000_000


@query(f"""WITH {X.FRAMES}, k AS (SELECT stream_id, max(pts) AS since FROM frames WHERE key_frame AND pts <= {12 * DAY} GROUP BY stream_id)
SELECT f.stream_id, pts, packet_index, key_frame, pts >= {12 * DAY} AS wanted FROM frames f LEFT JOIN k ON k.stream_id = f.stream_id WHERE (since IS NULL OR pts >= since) AND pts <= {15 * DAY}""")
def frames_from_a_key_frame(spark, sf):
    path = fresh_path(spark, "frames")
    frame_files.write(X.frames(spark, sf), path, slot=DAY)
    return frame_files.seek(spark, path, 12 * DAY, 15 * DAY)


@query(f"""WITH {X.FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pts, packet_index) - 1 AS n FROM frames WHERE pts >= {20 * DAY} AND pts <= {22 * DAY})
SELECT stream_id, pts, packet_index, key_frame, n // 2 AS frame_number FROM n WHERE n % 2 = 0""")
def frames_of_a_range(spark, sf):
    path = fresh_path(spark, "frames")
    frame_files.write(X.frames(spark, sf), path, slot=DAY)
    return frame_files.sample(spark, path, stride=2, start=20 * DAY, end=22 * DAY)


@query(f"""WITH {X.FRAMES}, {GROWING}, last AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY track ORDER BY n_samples DESC) = 1), steps AS (SELECT *, pts - lag(pts) OVER (PARTITION BY stream_id ORDER BY pts, packet_index) AS d FROM frames), runs AS (SELECT stream_id, count(*) AS n, max(pts) - min(pts) AS span, count(DISTINCT d) > 1 AS vfr FROM steps GROUP BY stream_id)
SELECT 'clip' AS source, NULL::VARCHAR AS output, (SELECT sum(n)::BIGINT FROM runs) AS frames_processed, (SELECT count(DISTINCT track) FROM few) AS tracks_created, count(*) FILTER (WHERE reason = 'accepted') AS tracks_identified, count(*) FILTER (WHERE reason <> 'accepted') AS tracks_unknown, (SELECT count(*) FROM runs) AS n_streams, (SELECT count(*) FILTER (WHERE vfr) FROM runs) AS n_vfr, (SELECT round(max(span) * 0.000001{D}, 6) FROM runs) AS duration_s FROM last""")
def run_manifest(spark, sf):
    created = X.samples(spark, sf).where("track % 5 <> 2 or seq < 2").select("track").distinct().count()
    return rounded(governance.run_manifest(progress.standing(_decisions(spark, sf)), frames.timing_report(X.frames(spark, sf)), created, "clip"), "duration_s")


@query(f"""WITH {X.BOXES} SELECT stream_id, frame_number, det, round((x1 + x2) / 2 - w * 1.25{D} / 2, 6) AS x1, round((y1 + y2) / 2 - h * 1.25{D} / 2, 6) AS y1, round((x1 + x2) / 2 + w * 1.25{D} / 2, 6) AS x2, round((y1 + y2) / 2 + h * 1.25{D} / 2, 6) AS y2, round_even(x1 / 3, 0)::BIGINT AS px1, round_even(y1 / 3, 0)::BIGINT AS py1, round_even(x2 / 3, 0)::BIGINT AS px2, round_even(y2 / 3, 0)::BIGINT AS py2 FROM boxes""")
def scaled_boxes(spark, sf):
    rows = X.boxes(spark, sf)
    large, third = box().scale(1.25), box().unletterbox(3, 0, 0).rounded()
    names = ("x1", "y1", "x2", "y2")
    out = rows.select("stream_id", "frame_number", "det", *[c.alias(f"p{n}") for n, c in zip(names, third, strict=True)], *[c.alias(n) for n, c in zip(names, large, strict=True)])
    return rounded(out, *names)
