"""Checks on the way in: each fails, or splits off, rows that break a table's contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.geometry import box


def unit_range(x: Column) -> Column:
    return F.coalesce((x >= 0) & (x <= 1), F.lit(False))


#: The contract of a detection, by name.
RULES = {
    "box": lambda: F.coalesce(box().valid, F.lit(False)),
    "score": lambda: unit_range(F.col("score")),
    "quality": lambda: unit_range(F.col("quality")),
    "landmarks": lambda: F.coalesce((F.size("landmarks") == 5) & F.forall("landmarks", lambda p: p["x"].isNotNull() & p["y"].isNotNull()), F.lit(False)),
}


def broken(rules: list[str]) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(~RULES[n](), F.lit(n)) for n in rules]))


def quarantined(rows: DataFrame, rules: list[str]) -> DataFrame:
    """Rows that break a rule, with ``broken``."""
    return rows.withColumn("broken", broken(rules)).where(F.size("broken") > 0)


def checked(rows: DataFrame, rules: list[str]) -> DataFrame:
    """Fails on the first row that breaks a rule."""
    message = F.concat(F.lit("a row breaks: "), F.array_join(broken(rules), ", "))
    first = rows.columns[0]
    kind = rows.schema[first].dataType
    return rows.withColumn(first, F.when(F.size(broken(rules)) > 0, F.raise_error(message).cast(kind)).otherwise(F.col(first)))


def consistent(rows: DataFrame, expected: int) -> DataFrame:
    """Fails unless the table has as many rows as its description says."""
    n = rows.count()
    if n != expected:
        raise ValueError(f"{n} rows, where {expected} are described")
    return rows
