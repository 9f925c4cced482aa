"""Rows numbered by ranges against a window."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.operators import order


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_numbers_equal_those_of_a_window(spark, parts):
    r = random.Random(parts)
    # one stream has most of the rows, and one is null
    rows = [(r.choice([1, 1, 1, 1, 1, 1, 2, 3, None]), r.randrange(-1000, 1000), k, "x") for k in range(3000)] + [(s, 5, -s, "y") for s in range(10, 200)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id bigint, pts bigint, packet_index bigint, part string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(map(tuple, order.numbered(df, "stream_id", ["pts", "packet_index"]).collect()), key=str)
        want = df.withColumn("n", F.row_number().over(W.partitionBy("stream_id").orderBy("pts", "packet_index")).cast("bigint") - 1)
        assert got == sorted(map(tuple, want.collect()), key=str)
        assert order.numbered(df.where("false"), "stream_id", ["pts"]).count() == 0
        assert sorted(x["n"] for x in order.numbered(df.where("stream_id = 1").withColumn("one", F.lit("a")), "one", ["pts", "packet_index"]).collect()) == list(range(sum(x[0] == 1 for x in rows)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
