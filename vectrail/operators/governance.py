"""Safeguards: redaction, retention, audit rows and run manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def redact(rows: DataFrame, accepted: Column, columns: list[str]) -> DataFrame:
    """Nulls the given columns of rows that were not accepted."""
    return rows.select(*[F.when(accepted, F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], (~F.coalesce(accepted, F.lit(False))).alias("redacted"))


def within_retention(rows: DataFrame, created: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(created) >= now - F.make_dt_interval(F.lit(days)))


def audit_rows(decisions: DataFrame, label: str = "UNKNOWN") -> DataFrame:
    """One row per decision, rejections included; floats at six decimals."""
    return decisions.select("query_id", F.when(F.col("accepted"), F.col("identity")).otherwise(label).alias("identity"), F.round("similarity", 6).alias("similarity"), F.round("margin", 6).alias("margin"), "accepted", "reason")


def identifications(decisions: DataFrame, threshold: Column, source: str | None = None, media_seconds: Column | None = None, label: str = "UNKNOWN", now: Column | None = None) -> DataFrame:
    """Full records of ``progress.decided``, rejections included: who, how alike, by which
    threshold, when, and from how many samples. A missing rival is written as margin 0;
    the final pass has frame -1 and no media time."""
    accepted = F.coalesce(F.col("accepted"), F.lit(False))
    seconds = F.lit(None).cast("double") if media_seconds is None else F.when(~F.col("finalised"), media_seconds)
    return decisions.select(
        F.lit("identification").alias("event"), F.col("track").alias("track_id"), F.when(accepted, F.col("identity")).otherwise(label).alias("identity"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"), F.round(F.coalesce("margin", F.lit(0.0)), 6).alias("margin"), F.round(threshold, 6).alias("threshold"), accepted.alias("accepted"),
        F.coalesce("seq", F.lit(-1)).alias("frame_number"), seconds.alias("media_seconds"), F.col("n_samples").alias("embeddings_fused"), F.round("coherence", 4).alias("coherence"),
        F.when(~accepted, F.col("reason")).alias("rejection_reason"), "finalised", F.lit(source).cast("string").alias("source"), (F.current_timestamp() if now is None else now).alias("timestamp_utc"),
    )


def append_audit(rows: DataFrame, path: str, day: Column) -> None:
    """Append-only JSON lines by day."""
    rows.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


AUDIT = "query_id bigint, identity string, similarity double, margin double, accepted boolean, reason string, day date"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """What ``append_audit`` wrote; blank lines are skipped, and a folder that
    does not exist is an empty log."""
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return spark.createDataFrame([], AUDIT)
    return spark.read.schema(AUDIT).json(path)


def save_manifest(counts: DataFrame, path: str) -> None:
    """One JSON line."""
    counts.coalesce(1).write.mode("overwrite").json(path)


def latest(decisions: DataFrame, order: str = "seq") -> DataFrame:
    """The last decision of each track: it stands, also where it takes back an earlier one."""
    return decisions.groupBy("track").agg(F.max_by(F.struct(*[c for c in decisions.columns if c != "track"]), order).alias("d")).select("track", "d.*")


def undecided(ready: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tracks with enough samples but no decision, for the final pass."""
    return ready.join(decisions.select("track").distinct(), "track", "left_anti")


def population(tracks: DataFrame) -> DataFrame:
    """Tracks by state."""
    return tracks.groupBy("state").agg(F.countDistinct("track_id").alias("n_tracks"))


def manifest(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count("*").alias("n_decided"), F.count_if("accepted").alias("n_identified"), F.count_if(~F.col("accepted")).alias("n_unknown"), F.round(F.coalesce(F.try_divide(F.count_if("accepted"), F.count("*")), F.lit(0.0)), 6).alias("acceptance_rate"))


def run_manifest(standing: DataFrame, timing: DataFrame, tracks_created: int | Column, source: str | None = None, output: str | None = None, tick: float = 1e-6) -> DataFrame:
    """One row on a run: frames and tracks, how many were identified, and its streams' timing, of the
    last decisions of tracks and ``frames.timing_report``. The decisions themselves are rows of their
    own (``identifications``), as there may be any number."""
    accepted = F.coalesce(F.col("accepted"), F.lit(False))
    decided = standing.agg(F.count_if(accepted).alias("tracks_identified"), F.count_if(~accepted).alias("tracks_unknown"))
    streams = timing.agg(F.coalesce(F.sum("n_frames"), F.lit(0)).alias("frames_processed"), F.count("*").alias("n_streams"), F.coalesce(F.max("span") * tick, F.lit(0.0)).alias("duration_s"), F.count_if("is_vfr").alias("n_vfr"))
    text = lambda x: F.lit(x).cast("string")
    created = F.lit(tracks_created).cast("bigint") if isinstance(tracks_created, int) else tracks_created
    both = streams.join(F.broadcast(decided))  # one row each
    return both.select(text(source).alias("source"), text(output).alias("output"), "frames_processed", created.alias("tracks_created"), "tracks_identified", "tracks_unknown", "n_streams", "n_vfr", "duration_s")
