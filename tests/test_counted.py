"""Counters of stages, fusion statistics and calibration on a sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.operators import counted, gallery


def test_counters_fill_in_the_pass_that_reads_the_table(spark):
    c = counted.Counters()
    rows = spark.range(100).withColumn("x", F.when(F.col("id") % 4 != 0, F.col("id")))
    first = c.watch(rows, "first", missing=F.count_if(F.col("x").isNull()), most=F.max("x"))
    second = c.watch(first.where("x is not null"), "second")
    none = c.watch(rows.where("id < 0"), "none", most=F.max("x"))
    assert second.count() == 75 and none.count() == 0
    got = {(r["stage"], r["counter"]): r["value"] for r in c.rows(spark).collect()}
    assert got == {("first", "rows"): 100, ("first", "missing"): 25, ("first", "most"): 99, ("second", "rows"): 75, ("none", "rows"): 0, ("none", "most"): None}
    with pytest.raises(ValueError):
        c.watch(rows, "first")


def test_fusion_statistics(spark):
    rows = [("a", k) for k in range(40)] + [("b", k) for k in range(2)] + [("c", k) for k in range(3)]
    got = counted.fusion_statistics(spark.createDataFrame(rows, "track string, seq bigint")).first()
    assert tuple(got) == (3, 2, 37, 45)
    assert tuple(counted.fusion_statistics(spark.createDataFrame([], "track string, seq bigint")).first()) == (0, 0, 0, 0)


def test_sampled_calibration_encloses_the_exact_quantile(spark):
    r = np.random.default_rng(11)
    v = r.normal(size=(600, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    # one identity has a third of all entries
    rows = [(i, "many" if i % 3 == 0 else f"id_{i // 2}", x.tolist()) for i, x in enumerate(v)] + [(1000, None, v[0].tolist()), (1001, "bad", None)]
    entries = spark.createDataFrame(rows, "entry_index bigint, identity string, vector array<double>").repartition(5)
    some = gallery.calibration_sample(entries, 320)
    names = [x["identity"] for x in some.collect()]
    assert len(names) == 320 and set(names) >= {n for _, n, x in rows if x} and "bad" not in names
    assert sorted(x["entry_index"] for x in some.collect()) == sorted(x["entry_index"] for x in gallery.calibration_sample(entries.repartition(2), 320).collect())
    exact = gallery.impostor_quantile(entries, 0.99).first()["quantile"]
    found = gallery.sampled_threshold(entries, 320, far=0.01, configured=0.1).first()
    assert found["n_entries"] == 320 and found["low"] <= exact <= found["high"] and found["threshold"] == max(found["quantile"], 0.1)
    whole = gallery.sampled_threshold(entries, 10_000, far=0.01, configured=0.1).first()
    assert whole["quantile"] == pytest.approx(exact) and whole["n_entries"] == 601
    few = gallery.sampled_threshold(entries.where("entry_index < 5"), 10, configured=0.4).first()
    assert few["threshold"] == 0.4
    low, high = gallery.quantile_bounds(0.999, 4096)
    assert 0.99 < low < 0.999 < high <= 1 and gallery.quantile_bounds(0.5, 1)[0] == 0
