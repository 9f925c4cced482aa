"""Detection-like tables derived from the provided ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions.vectors import add, normalise, times


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark, sf) -> DataFrame:
    pts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return read(spark, sf, "events").select(F.col("user_id").alias("stream_id"), pts.alias("pts"), F.col("event_id").alias("packet_index"), (F.col("event_id") % 30 == 0).alias("key_frame"))


FRAMES = "frames AS (SELECT user_id AS stream_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS pts, event_id AS packet_index, event_id % 30 = 0 AS key_frame FROM events)"


def boxes(spark, sf) -> DataFrame:
    det = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
    x = read(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 10).alias("stream_id"),
        F.floor(F.col("l_orderkey") / 10).cast("bigint").alias("frame_number"),
        det.cast("bigint").alias("det"),
        ((F.col("l_partkey") * 37) % 400).cast("double").alias("x1"),
        ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 29) % 300).cast("double").alias("y1"),
        (20 + (F.col("l_partkey") * 7) % 180).cast("double").alias("w"),
        (40 + (F.col("l_linenumber") * 61 + F.col("l_partkey")) % 300).cast("double").alias("h"),
        (F.col("l_quantity") / 50).alias("score"),
        F.col("l_partkey").alias("part"),
    )
    return x.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("h"))


BOXES = """boxes0 AS (SELECT l_orderkey % 10 AS stream_id, l_orderkey // 10 AS frame_number,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS det,
 ((l_partkey * 37) % 400)::DOUBLE AS x1, ((l_suppkey * 53 + l_linenumber * 29) % 300)::DOUBLE AS y1,
 (20 + (l_partkey * 7) % 180)::DOUBLE AS w, (40 + (l_linenumber * 61 + l_partkey) % 300)::DOUBLE AS h,
 l_quantity / 50 AS score, l_partkey AS part FROM lineitem),
boxes AS (SELECT *, x1 + w AS x2, y1 + h AS y2 FROM boxes0)"""


def faces(spark, sf) -> DataFrame:
    """A face at the head of every box with an odd number, with five landmarks."""
    b = boxes(spark, sf).where("det % 2 = 1")
    side = F.greatest(F.lit(24.0), F.floor(F.col("w") / 2))
    b = b.withColumn("side", side).withColumn("fx1", F.col("x1") + F.col("w") / 2 - F.col("side") / 2 + (F.col("part") % 5 - 2) * F.col("w") / 6).withColumn("fy1", F.col("y1") + F.col("h") / 20)
    points = [("lx", "ly", 0.3, 0.4), ("rx", "ry", 0.7, 0.4), ("nx", "ny", 0.5, 0.6), ("ax", "ay", 0.35, 0.8), ("bx", "by", 0.65, 0.8)]
    for px, py, u, v in points:
        y = F.col("fy1") + F.col("side") * v
        b = b.withColumn(px, F.col("fx1") + F.col("side") * u).withColumn(py, y + (F.col("part") % 7 - 3) if py == "ry" else y)
    return b.select("stream_id", "frame_number", F.col("det").alias("face"), F.col("fx1"), F.col("fy1"), (F.col("fx1") + F.col("side")).alias("fx2"), (F.col("fy1") + F.col("side")).alias("fy2"), *[c for p in points for c in p[:2]])


FACES = (
    BOXES
    + """, faces0 AS (SELECT *, greatest(24.0, floor(w / 2))::DOUBLE AS side FROM boxes WHERE det % 2 = 1),
faces1 AS (SELECT *, x1 + w / 2 - side / 2 + (part % 5 - 2) * w / 6 AS fx1, y1 + h / 20 AS fy1 FROM faces0),
faces AS (SELECT stream_id, frame_number, det AS face, fx1, fy1, fx1 + side AS fx2, fy1 + side AS fy2,
 fx1 + side * 0.3::DOUBLE AS lx, fy1 + side * 0.4::DOUBLE AS ly, fx1 + side * 0.7::DOUBLE AS rx, fy1 + side * 0.4::DOUBLE + (part % 7 - 3) AS ry,
 fx1 + side * 0.5::DOUBLE AS nx, fy1 + side * 0.6::DOUBLE AS ny, fx1 + side * 0.35::DOUBLE AS ax, fy1 + side * 0.8::DOUBLE AS ay,
 fx1 + side * 0.65::DOUBLE AS bx, fy1 + side * 0.8::DOUBLE AS "by" FROM faces1)"""
)


def quality_rows(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("stream_id"), e.alias("seq"), (10 + F.col("value") * 0.4).alias("norm"), (F.col("value") * 2).alias("sharpness"), ((e * 13) % 256).cast("double").alias("brightness"), ((e % 20) / 100).alias("truncation"), (10 + e % 70).cast("double").alias("eye_distance"), (0.5 + (e % 8) * 0.25).alias("scale"), (0.4 + (e % 60) / 100).alias("detection_score"), (F.col("event_type") != "error").alias("norm_calibrated")
    )


QUALITY = "q AS (SELECT user_id % 10 AS stream_id, event_id AS seq, 10 + value * 0.4::DOUBLE AS norm, value * 2 AS sharpness, ((event_id * 13) % 256)::DOUBLE AS brightness, (event_id % 20) / 100::DOUBLE AS truncation, (10 + event_id % 70)::DOUBLE AS eye_distance, 0.5::DOUBLE + (event_id % 8) * 0.25::DOUBLE AS scale, 0.4::DOUBLE + (event_id % 60) / 100::DOUBLE AS detection_score, event_type <> 'error' AS norm_calibrated FROM events)"


def vectors(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def gallery(spark, sf) -> DataFrame:
    return vectors(spark, sf).where("vec_id % 5 <> 0").select(F.col("vec_id").alias("entry_index"), F.concat(F.lit("id_"), F.floor(F.col("vec_id") / 3).cast("bigint").cast("string")).alias("identity"), F.col("v").alias("vector"))


def probes(spark, sf) -> DataFrame:
    """Every vector with a share of its seventh successor."""
    v = vectors(spark, sf)
    n = v.agg(F.count("*").alias("n"))
    other = v.select(F.col("vec_id").alias("o"), F.col("v").alias("ov"))
    at = v.join(F.broadcast(n)).withColumn("o", (F.col("vec_id") + 7) % F.col("n"))  # one row
    return at.join(other, "o").select(F.col("vec_id").alias("query_id"), normalise(add(F.col("v"), times(F.col("ov"), F.lit(0.6)))).alias("vector"))


SEARCH = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
gallery AS (SELECT vec_id AS entry_index, 'id_' || (vec_id // 3) AS identity, v AS vector FROM e WHERE vec_id % 5 <> 0),
mixed AS (SELECT a.vec_id AS query_id, list_transform(list_zip(a.v, b.v), lambda x: x[1] + 0.6::DOUBLE * x[2]) AS w FROM e a JOIN e b ON b.vec_id = (a.vec_id + 7) % (SELECT count(*) FROM e)),
probes AS (SELECT query_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS vector FROM mixed),
ranked AS (SELECT query_id, entry_index, identity, list_dot_product(p.vector, g.vector) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(p.vector, g.vector) DESC, entry_index) AS rank FROM probes p, gallery g),
hits AS (SELECT * FROM ranked WHERE rank <= 5)"""
IMPOSTORS = "impostors AS (SELECT round(list_dot_product(a.vector, b.vector), 6) AS similarity FROM gallery a JOIN gallery b ON a.entry_index < b.entry_index AND a.identity <> b.identity), calibrated AS (SELECT count(*) AS n_pairs, quantile_cont(similarity, 0.999) AS quantile FROM impostors), threshold AS (SELECT n_pairs, quantile, CASE WHEN n_pairs < 100 THEN 0.35::DOUBLE ELSE greatest(quantile, 0.35::DOUBLE) END AS threshold FROM calibrated)"
BEST = "tops AS (SELECT query_id, max(identity) FILTER (WHERE rank = 1) AS identity, max(similarity) AS similarity FROM hits GROUP BY query_id), best AS (SELECT t.query_id, t.identity, t.similarity, t.similarity - max(h.similarity) FILTER (WHERE h.identity <> t.identity) AS margin FROM tops t JOIN hits h ON h.query_id = t.query_id GROUP BY t.query_id, t.identity, t.similarity)"
DECIDE = "decisions AS (SELECT query_id, best.identity, similarity, margin, CASE WHEN similarity < threshold THEN 'below_threshold' WHEN margin < 0.05 THEN 'ambiguous' ELSE 'accepted' END AS reason FROM best, threshold)"


def samples(spark, sf) -> DataFrame:
    """25 tracks of noisy copies of a base vector; every fifth mixes two bases."""
    v = vectors(spark, sf)
    track, seq = F.col("vec_id") % 25, F.floor(F.col("vec_id") / 25).cast("bigint")
    base = F.when((track % 5 == 1) & (seq % 2 == 1), track + 25).otherwise(track)
    rows = v.select(track.alias("track"), seq.alias("seq"), base.alias("b"), F.pow((F.col("vec_id") % 10 + 1) / 10.0, 2).alias("weight"), "v")
    bases = v.where("vec_id < 50").select(F.col("vec_id").alias("b"), F.col("v").alias("bv"))
    return rows.join(bases, "b").select("track", "seq", "weight", normalise(add(F.col("bv"), times(F.col("v"), F.lit(0.5)))).alias("vector"))


SAMPLES = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s0 AS (SELECT vec_id % 25 AS track, vec_id // 25 AS seq, ((vec_id % 10 + 1) / 10.0::DOUBLE) ** 2 AS weight, v, CASE WHEN (vec_id % 25) % 5 = 1 AND (vec_id // 25) % 2 = 1 THEN vec_id % 25 + 25 ELSE vec_id % 25 END AS b FROM e),
s1 AS (SELECT track, seq, weight, list_transform(list_zip(e.v, s0.v), lambda x: x[1] + 0.5::DOUBLE * x[2]) AS w FROM s0 JOIN e ON e.vec_id = s0.b),
samples AS (SELECT track, seq, weight, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS vector FROM s1),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY seq DESC) AS n FROM samples) WHERE n <= 32)"""
