"""A gallery as a Parquet table, checked on the way in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions.vectors import norm
from vectrail.sources.checks import consistent

SCHEMA = "entry_index bigint, identity string, vector array<double>, source string"


def checked(rows: DataFrame, dim: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Fails on vectors that are not of unit length or not of dimension ``dim``."""
    bad = F.col("vector").isNull() | (F.abs(norm(F.col("vector")) - 1) > tolerance)
    if dim is not None:
        bad = bad | (F.size("vector") != dim)
    return rows.withColumn("vector", F.when(bad, F.raise_error(F.concat(F.lit("bad vector in entry "), F.col("entry_index").cast("string")))).otherwise(F.col("vector")))


def _about(path: str) -> str:
    return path.rstrip("/") + ".about"


def save(rows: DataFrame, path: str) -> None:
    """The checked rows, and beside them how many there are."""
    if rows.isEmpty():
        raise ValueError("an empty gallery is not saved")
    checked(rows).write.mode("overwrite").parquet(path)
    spark = rows.sparkSession
    written = spark.read.schema(SCHEMA).parquet(path).agg(F.count("*").alias("entries"), F.max(F.size("vector")).alias("dim"))
    written.coalesce(1).write.mode("overwrite").json(_about(path))


def load(spark: SparkSession, path: str, described: bool = True) -> DataFrame:
    """Fails unless there are as many rows as ``save`` described (unless ``described`` is waived)
    and all vectors are of unit length and of the described dimension."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if not described:
        return checked(rows)
    about = spark.read.schema("entries bigint, dim int").json(_about(path)).first()
    if about is None:
        raise ValueError(f"{path} has no description")
    return checked(consistent(rows, about["entries"]), about["dim"])
