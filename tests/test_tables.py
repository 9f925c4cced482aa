"""Galleries with their descriptions, boxes that cannot be scaled, and manifests of empty runs."""

import pytest

from vectrail.functions.geometry import box
from vectrail.operators import frames, governance
from vectrail.sources import gallery_table


def test_a_gallery_must_have_the_rows_it_describes(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"id_{k}", [0.6, 0.8], "x") for k in range(10)], gallery_table.SCHEMA).repartition(3)
    path = str(tmp_path / "g")
    gallery_table.save(rows, path)
    assert gallery_table.load(spark, path).count() == 10
    # a file is lost, or one with other vectors is put in
    lost = max((tmp_path / "g").glob("*.parquet"), key=lambda p: p.stat().st_size)
    lost.rename(tmp_path / "away.parquet")
    with pytest.raises(ValueError, match="where 10 are described"):
        gallery_table.load(spark, path)
    assert 0 < gallery_table.load(spark, path, described=False).count() < 10
    n = 10 - gallery_table.load(spark, path, described=False).count()
    spark.createDataFrame([(90 + k, "long", [0.6, 0.8, 0.0], "x") for k in range(n)], gallery_table.SCHEMA).write.mode("append").parquet(path)
    with pytest.raises(Exception, match="bad vector"):
        gallery_table.load(spark, path).collect()


def test_boxes_are_scaled_by_factors_above_zero():
    for f in (0, -1.5):
        with pytest.raises(ValueError):
            box().scale(f)


def test_manifest_of_an_empty_run(spark):
    standing = spark.createDataFrame([], "track string, accepted boolean")
    none = frames.timing_report(spark.createDataFrame([], "stream_id bigint, pts bigint, packet_index bigint"))
    assert tuple(governance.run_manifest(standing, none, 0).first()) == (None, None, 0, 0, 0, 0, 0, 0, 0.0)
    some = spark.createDataFrame([("a", True), ("b", False), ("c", None)], standing.schema)
    assert tuple(governance.run_manifest(some, none, 3, "s", "o").first())[:6] == ("s", "o", 0, 3, 1, 2)
