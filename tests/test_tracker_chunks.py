"""Streams that are tracked in chunks against the kernel fed in one piece."""

import random

import pandas as pd
import pytest

from vectrail.operators import tracker

BOXES = "stream_id bigint, frame_number bigint, det bigint, x1 double, y1 double, x2 double, y2 double, score double"


def crowded(seed, streams, frames, first=-300, still=False):
    """Boxes at random in a small scene, with some gaps; with ``still`` also one that stays for good."""
    r = random.Random(seed)
    rows = []
    for s in range(streams):
        for f in range(first, first + frames):
            if still:
                rows.append((s, f, 0, 900.0, 900.0, 950.0, 950.0, 0.9))
            if f % 701 > 640:
                continue
            for d in range(1, r.choice([1, 1, 2, 4, 5])):
                x, y = float(r.randrange(400)), float(r.randrange(300))
                rows.append((s, f, d, x, y, x + 20 + r.randrange(180), y + 40 + r.randrange(300), r.random()))
    return rows


def in_one_piece(rows):
    columns = [c.split()[0] for c in BOXES.split(", ")]
    streams = sorted({x[0] for x in rows})
    return pd.concat([tracker.run_frames(tracker.Tracker(s), pd.DataFrame([x for x in rows if x[0] == s], columns=columns)) for s in streams])


def same(got, want):
    key = ["stream_id", "frame_number", "track_id"]
    want, got = (x.sort_values(key).reset_index(drop=True) for x in (want, got))
    pd.testing.assert_frame_equal(want, got, check_dtype=False, check_exact=True)


@pytest.mark.parametrize("chunk, warm", [(64, 0), (64, 40), (256, 256), (1024, 256)])
def test_chunks_equal_one_piece(spark, chunk, warm):
    rows = crowded(1, 2, 3000)
    d = spark.createDataFrame(rows, BOXES).repartition(5)
    got = tracker.track(d, chunk=chunk, warm=warm).toPandas()
    same(got, in_one_piece(rows))
    assert len(got) > 1000


def test_track_that_never_ends(spark):
    # no chunk can begin with the right tracks before the one before it is known
    rows = crowded(2, 2, 1500, still=True)
    got = tracker.track(spark.createDataFrame(rows, BOXES), chunk=100, warm=30).toPandas()
    same(got, in_one_piece(rows))
    assert got.groupby("track_id")["frame_number"].count().max() > 1400


def test_stream_without_gaps_is_many_tasks(spark):
    n = 200_000
    d = spark.range(n).selectExpr("7L AS stream_id", "id AS frame_number", "0L AS det", "double(id % 50) AS x1", "0D AS y1", "double(id % 50 + 60) AS x2", "90D AS y2", "0.9D AS score")
    d = d.where("frame_number % 20000 < 19960")
    found = tracker.track(d)
    files = [p.count() for p in (found.where(f"frame_number div {tracker.CHUNK} = {k}") for k in range(6))]
    assert min(files) > 0.9 * tracker.CHUNK and found.count() == found.select("frame_number", "track_id").distinct().count()
    # rows of a stream lie in many files, so many tasks wrote them
    assert found.selectExpr("input_file_name() AS f").distinct().count() >= 4


def test_chunks_too_short(spark):
    d = spark.createDataFrame([], BOXES)
    with pytest.raises(ValueError):
        tracker.track(d, chunk=20, warm=10)
    with pytest.raises(ValueError):
        tracker.track(d, chunk=100, warm=200)
