"""Frames by time: the same rows as from the whole table, from fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from vectrail.operators import frames
from vectrail.sources import frame_files

SCHEMA = "stream_id bigint, pts bigint, packet_index bigint, key_frame boolean"


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(2)
    rows = [(s, 40 * k + r.randrange(30), k, k % 25 == (0 if s else 7)) for s in range(4) for k in range(1000)]
    rows += [(9, 20_000 + 40 * k, k, False) for k in range(300)]  # no key frame
    rows += [(8, 30_000 + 40 * k, k, k == 0) for k in range(50)] + [(8, None, 50, True), (None, 21_000, 1, True)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def path(table, tmp_path_factory):
    where = "file://" + str(tmp_path_factory.mktemp("frames"))
    frame_files.write(table[1], where, slot=4_000)
    return where


def plain(rows, target, end):
    out = []
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s and r[1] is not None]
        keys = [r[1] for r in own if r[3] and r[1] <= target and s is not None]
        out += [(*r, r[1] >= target) for r in own if r[1] >= (max(keys) if keys else r[1]) and (end is None or r[1] <= end)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("target", "end"), [(25_000, 26_000), (25_000, None), (0, 100), (10**6, None)])
def test_seek_starts_at_key_frames(spark, table, path, target, end):
    got = frame_files.seek(spark, path, target, end).select("stream_id", "pts", "packet_index", "key_frame", "wanted")
    assert sorted(map(tuple, got.collect()), key=str) == plain(table[0], target, end)


def test_seek_reads_few_files(spark, table, path):
    seek = frame_files.seek(spark, path, 25_000, 26_000, streams=[0, 1, 2, 3])
    seek.collect()
    plan = seek._jdf.queryExecution().executedPlan().toString()
    assert "(slot" in plan and ">= 6)" in plan and "<= 6)" in plan
    # of eleven slots one is read
    slots = spark.read.parquet(f"{path}/frames").select("slot").distinct().count()
    read = spark.read.parquet(f"{path}/frames").where("slot >= 6 and slot <= 6").select(F.input_file_name()).distinct().count()
    assert slots >= 10 and 0 < read <= len(spark.read.parquet(f"{path}/frames").inputFiles()) // 3
    plan = frame_files._within(spark.read.parquet(f"{path}/frames"), 4_000, 25_000, 26_000)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "GreaterThanOrEqual(pts,25000)" in plan


@pytest.mark.parametrize("options", [{}, {"start": 20_000, "end": 23_000}, {"start": 39_000, "stride": 3}, {"end": 500, "max_frames": 4, "stride": 2}])
def test_sample_equals_the_whole_table(spark, table, path, options):
    columns = ["stream_id", "pts", "packet_index", "key_frame", "frame_number"]
    got = frame_files.sample(spark, path, **options).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, frames.sample(table[1], **options).select(columns).collect()), key=str) and got
