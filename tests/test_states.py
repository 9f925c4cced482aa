"""Stateful streams against their batch forms, over replayed files and a restart from the checkpoint."""

import random
import time

import numpy as np
import pytest

from vectrail.operators import frames, progress, quality_gate
from vectrail.streaming import states


@pytest.fixture(scope="module")
def session(spark):
    name, shuffles = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.shuffle.partitions")
    before = spark.conf.get(name, None)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield states.prepared(spark)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def replayed(spark, rows, schema, order, through, tmp_path, parts=2):
    """Rows as files, read one a micro-batch; the query is stopped half way and started again."""
    rows = sorted(rows, key=order)
    cut = -(-len(rows) // parts)

    def send(some):
        for k in some:
            part = rows[k * cut : (k + 1) * cut]
            random.Random(k).shuffle(part)  # a batch is put in order
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = through(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    send(range(parts // 2))
    run()
    send(range(parts // 2, parts))
    run()
    return spark.read.parquet(str(tmp_path / "out")).collect()


@pytest.mark.parametrize(("strategy", "count_all"), [("weighted_mean", False), ("median", True)])
def test_fusion_of_a_stream_equals_the_batch_form(session, tmp_path, strategy, count_all):
    r = np.random.default_rng(3)
    rows = []
    for t in range(5):
        base = r.normal(size=3)
        for k in range((2, 7, 31, 40, 75)[t]):
            v = base + 0.4 * r.normal(size=3)
            rows.append((f"t{t}", 10 * k + t, float(r.random()), (v / np.linalg.norm(v)).tolist()))
    rows += [("zero", 3, 0.5, [1.0, 0.0]), ("zero", 5, 0.5, [-1.0, 0.0]), ("zero", 7, 0.5, [0.0, 0.0]), ("zero", 9, 0.5, [0.0, 1.0]), ("zero", 400, 0.5, None)]
    schema = "track string, seq bigint, weight double, vector array<double>"
    got = {(x["track"], x["seen"]): x for x in replayed(session, rows, schema, lambda x: x[1], lambda s: states.fuse_stream(s, strategy, count_all=count_all), tmp_path)}
    want = {(x["track"], x["seen"]): x for x in progress.growing(session.createDataFrame(rows, schema), strategy, count_all=count_all).collect()}
    assert got.keys() == want.keys() and len(got) > 10
    for k, x in want.items():
        assert (got[k]["seq"], got[k]["n_samples"]) == (x["seq"], x["n_samples"])
        assert np.allclose(got[k]["vector"], x["vector"], atol=1e-9) and np.allclose([got[k]["mean_weight"], got[k]["coherence"]], [x["mean_weight"], x["coherence"]], atol=1e-9)
    with pytest.raises(ValueError):
        states.fuse_stream(session.createDataFrame(rows, schema), "ema")


def test_thresholds_of_a_stream_equal_the_batch_form(session, tmp_path):
    r = np.random.default_rng(4)
    rows = [(s, k, None if k % 41 == 7 else float(r.uniform(10, 50)), k % 9 != 4) for s in (1, 2) for k in range(700 if s == 1 else 90)]
    schema = "stream_id bigint, seq bigint, norm double, norm_calibrated boolean"
    got = {(x["stream_id"], x["seq"]): x["threshold"] for x in replayed(session, rows, schema, lambda x: x[1], states.threshold_stream, tmp_path)}
    want = {(x["stream_id"], x["seq"]): x["threshold"] for x in quality_gate.adaptive_threshold(session.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want) and len(set(want.values())) > 100


def test_arrival_counts_of_a_stream_equal_the_batch_form(session, tmp_path):
    r = random.Random(5)
    rows = [(s, k, None if r.random() < 0.1 else 100 * k + r.randrange(-150, 150)) for s in (1, 2, 3) for k in range(120)]
    schema = "stream_id bigint, packet_index bigint, pts bigint"
    last = {}
    for x in replayed(session, rows, schema, lambda x: x[1], states.arrival_counts, tmp_path):
        if x["n_decoded"] > last.get(x["stream_id"], (0,))[0]:
            last[x["stream_id"]] = (x["n_decoded"], x["n_dropped"], x["n_out_of_order"])
    table = session.createDataFrame(rows, schema)
    want = {x["stream_id"]: (x["n_decoded"], x["n_dropped"], x["n_out_of_order"]) for x in frames.counts(table, table).collect()}
    assert last == want and all(b > 0 and c > 0 for _, b, c in want.values())


@pytest.mark.parametrize(("idle", "seen"), [(3_600_000, [3, 8]), (1, [3, 3])])
def test_an_idle_key_is_forgotten(session, tmp_path, idle, seen):
    """The state lives as long as it is told to; a key that comes back later begins anew."""
    schema = "track string, seq bigint, weight double, vector array<double>"
    out = tmp_path / "out"
    for half in (0, 1):
        session.createDataFrame([("a", 4 * half + k, 1.0, [1.0, 0.0]) for k in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = session.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = states.fuse_stream(source, idle=idle).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").start()
        until = time.time() + 40
        # such a query goes on without data, to let states expire
        while time.time() < until and sum(p["numInputRows"] for p in q.recentProgress) < 4:
            time.sleep(0.2)
        q.stop()
    assert sorted(x["seen"] for x in session.read.parquet(str(out)).collect()) == seen
