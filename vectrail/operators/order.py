"""Numbering the rows of each key in order, without a task for each key.

Rows are dealt by ranges of (key, order), so a key of many rows lies in many partitions.
Each partition numbers what it has, and a key that goes on from one partition to the
next is numbered on from there: of such keys there are no more than partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.sources.shared import stored


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with ``name``, from 0, within each key (null is one) by ``order``. Rows that are equal in
    both are numbered in any order, and should be few."""
    own = {"part": f"{name}__part", "first": f"{name}__first"}
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn(own["part"], F.spark_partition_id())
    at = rows.columns.index(key)
    schema = T.StructType([*rows.schema.fields, T.StructField(own["part"], T.IntegerType()), T.StructField(name, T.LongType())])

    def run(batches):
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(at)
            values = keys.to_pylist()
            change = np.ones(b.num_rows, bool)
            change[1:] = [x != y for x, y in zip(values[1:], values)]
            change[0] = last is None or values[0] != last[0]
            begins = np.flatnonzero(change)
            n = np.arange(b.num_rows, dtype=np.int64)
            start = np.zeros(b.num_rows, np.int64)
            start[begins] = begins
            n -= np.maximum.accumulate(start)
            head = begins[0] if len(begins) else b.num_rows
            n[:head] += count  # what goes on from the batch before
            last, count = (values[-1],), int(n[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=[*b.schema.names, name])

    local = stored(dealt.mapInArrow(run, schema), "numbered")
    sizes = local.groupBy(F.col(key).alias("k"), F.col(own["part"]).alias("p")).agg(F.count("*").alias("rows"))
    # of the keys that lie in several partitions; a partition but the first goes on with one of them at most
    several = sizes.groupBy("k").agg(F.collect_list(F.struct("p", "rows")).alias("parts")).where(F.size("parts") > 1)
    before = F.transform("parts", lambda x: F.struct(x["p"].alias("p"), F.aggregate(F.filter("parts", lambda y: y["p"] < x["p"]), F.lit(0).cast("bigint"), lambda s, y: s + y["rows"]).alias("before")))
    offsets = several.select("k", F.explode(before).alias("x")).select("k", "x.p", F.col("x.before").alias(own["first"]))
    on = F.col(key).eqNullSafe(F.col("k")) & (F.col(own["part"]) == F.col("p"))
    return local.join(F.broadcast(offsets), on, "left").select(*rows.columns, (F.col(name) + F.coalesce(own["first"], F.lit(0))).alias(name))
