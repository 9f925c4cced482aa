"""Enrolment: reference images by identity, the reasons to refuse one, reports and consent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.operators.detections import MAX_ROLL, upright

#: Suffixes of images.
SUFFIXES = ["bmp", "jpeg", "jpg", "png", "webp"]
MIN_QUALITY = 0.0


def discover(spark: SparkSession, root: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """``(identity, source)`` of the images below ``root``, one folder an identity,
    in order. Hidden files and folders and other suffixes are left out; without
    any image it fails."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("source"))
    parts = F.split("source", "/")
    name, identity = F.element_at(parts, -1), F.element_at(parts, -2)
    depth = len([x for x in root.rstrip("/").split("://")[-1].split("/") if x])
    inside = F.size(F.filter(F.split(F.regexp_replace("source", "^[a-z0-9]+:/*", ""), "/"), lambda x: x != "")) == depth + 2
    found = files.where(inside & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(suffixes) & ~name.startswith(".") & ~identity.startswith("."))
    found = found.select(identity.alias("identity"), "source").orderBy("identity", "source")
    if found.isEmpty():
        raise FileNotFoundError(f"no identity folders with images in {root}")
    return found


def refusal(min_quality: float = MIN_QUALITY, max_roll: float | None = MAX_ROLL) -> Column:
    """The first rule that an image ``(readable, n_faces, roll, reasons, score)``
    breaks, or null."""
    rolled = F.lit(False) if max_roll is None else ~F.coalesce(upright(F.col("roll"), max_roll), F.lit(False))
    return (
        F.when(~F.coalesce("readable", F.lit(False)), "unreadable")
        .when(F.coalesce("n_faces", F.lit(0)) == 0, "no_face")
        .when(F.col("n_faces") > 1, "many_faces")
        .when(rolled, "roll")
        .when(F.size("reasons") > 0, F.concat(F.lit("gate: "), F.array_join("reasons", "; ")))
        .when(F.col("score") < min_quality, "low_quality")
    )


def report(images: DataFrame) -> DataFrame:
    """Per identity, of images with ``reason`` (null: enrolled) and ``score``: how
    many were enrolled and refused, their mean score, and a warning if any."""
    ok = F.col("reason").isNull()
    g = images.groupBy("identity").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.avg(F.when(ok, F.col("score"))).alias("mean_quality"))
    return g.withColumn("warning", F.when(F.col("accepted") == 0, "none enrolled").when(F.col("accepted") == 1, "single reference"))


def impostor_report(figures: DataFrame, high: float = 0.5) -> DataFrame:
    """The one row of ``gallery.impostor_quantile`` with a warning where entries
    of different identities are alike."""
    return figures.withColumn("warning", F.when(F.col("largest") > high, "one person under two names?"))


def consent_template(entries: DataFrame) -> DataFrame:
    """A row an identity with nothing filled in, which is no consent."""
    blank = [F.lit("").alias(c) for c in ("basis", "obtained_on", "expires_on")]
    return entries.select("identity").where("identity is not null").distinct().orderBy("identity").select("identity", *blank)
