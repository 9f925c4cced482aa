"""Search and impostor pairs by cells of a grid: what meets in a task is bounded, and nothing is lost."""

import numpy as np
import pyarrow as pa
import pytest

from vectrail.operators import gallery

SCHEMA = "entry_index bigint, identity string, vector array<double>"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_row_holds_a_pair_of_blocks(spark):
    g = spark.createDataFrame([(k, f"p{k}", [1.0, float(k)]) for k in range(9)], SCHEMA)
    q = g.selectExpr("entry_index AS query_id", "vector")
    for df in (gallery.top_hits(q, g, size=2), gallery.identity_hits(q, g, size=2), gallery.impostors(g, size=2)):
        assert "b_matrix" not in plan(df) and "CoGroup" in plan(df)


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("apart", [False, True])
def test_best_of_a_cell_with_ties_and_small_tiles(monkeypatch, metric, apart):
    monkeypatch.setattr(gallery, "TILE", 700)
    r = np.random.default_rng(8)
    g = np.repeat(r.normal(size=(100, 3)).round(1), 5, axis=0)[r.permutation(500)]  # five of each
    q = np.concatenate([r.normal(size=(20, 3)), np.zeros((2, 3))])  # to the last all are alike
    entries, names = r.permutation(500), np.array([f"p{k % 9}" for k in range(500)])
    s = gallery.similarities(q, g, metric)
    got = {}
    for b in gallery.nearest(np.arange(22), q, entries, pa.array(names), g, 4, metric, apart):
        for row in b.to_pylist():
            got.setdefault(row["query_id"], []).append((row["entry_index"], row["identity"], row["similarity"]))
    for at in range(22):
        order, seen, want = sorted(range(500), key=lambda o: (-s[at, o], entries[o])), set(), []
        for o in order:
            if not apart or names[o] not in seen:
                want.append((entries[o], names[o], s[at, o]))
                seen.add(names[o])
        assert [x[:2] for x in got[at]] == [x[:2] for x in want[:4]] and np.allclose([x[2] for x in got[at]], [x[2] for x in want[:4]], atol=2e-12)


@pytest.mark.parametrize("length", [1.0, 3.0])
def test_every_impostor_pair_is_met_once(spark, length):
    r = np.random.default_rng(9)
    v = r.normal(size=(240, 6))
    v *= length / np.linalg.norm(v, axis=1, keepdims=True)
    names = [None if k % 11 == 0 else f"p{k % 13}" for k in range(240)]
    g = spark.createDataFrame([(k, n, x.tolist()) for k, (n, x) in enumerate(zip(names, v, strict=True))], SCHEMA).repartition(3)
    pairs = np.round([v[i] @ v[j] for i in range(240) for j in range(i) if (names[i] or "") != (names[j] or "")], 6)
    for size in (16, 2048):  # several parts and few
        got = gallery.impostor_quantile(g, 0.9, size).first()
        assert got["n_pairs"] == len(pairs)
        assert got["quantile"] == pytest.approx(np.quantile(pairs, 0.9), abs=2e-6) and got["mean"] == pytest.approx(pairs.mean(), abs=1e-6) and got["largest"] == pytest.approx(pairs.max(), abs=2e-6)
