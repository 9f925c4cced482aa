"""The stored cell index against the exact search; other metrics and margins against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.operators import cell_index, gallery

SCHEMA = "entry_index bigint, identity string, vector array<double>"


def clustered(n=3000, centres=40, dim=16, seed=2):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    v = c[r.integers(centres, size=n)] + 0.25 * r.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[: n // 3] = v[0]  # a third are equal
    return [(i, f"id_{i % 900}", x.tolist()) for i, x in enumerate(v)]


@pytest.fixture(scope="module")
def entries(spark):
    odd = [(9001, "none", None), (9002, "nan", [float("nan")] * 16), (9003, "short", [1.0, 0.0]), (None, "no key", [1.0] * 16)]
    return spark.createDataFrame(clustered() + odd, SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def index(entries, tmp_path_factory):
    return cell_index.write(entries, "file://" + str(tmp_path_factory.mktemp("index")), least=100)


def asked(entries, which):
    return entries.where(which).select(F.col("entry_index").alias("query_id"), "vector")


def test_index_finds_what_the_exact_search_finds(spark, entries, index):
    assert 40 <= index.cells <= 60 and not index.exact and index.rows == 3001
    q = asked(entries, "entry_index % 37 = 0")
    exact = gallery.top_hits(q, entries)
    found = cell_index.search(index, q)
    r = cell_index.recall(found, exact).first()
    assert r["n_queries"] == 82 and r["n_hits"] == 410 and r["recall"] >= 0.9
    # with all cells it is the exact search
    same = cell_index.search(index, q, probes=index.cells)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, exact.collect()))
    one = cell_index.search(index, q.limit(0))
    assert one.count() == 0


def test_index_holds_every_comparable_row_once(spark, entries, index):
    ids = [r["entry_index"] for r in index.entries.collect()]
    assert sorted(ids) == list(range(3000)) + ([9003] if 9003 in ids else [])
    sizes = {r["cell"]: r["count"] for r in index.entries.groupBy("cell").count().collect()}
    assert max(sizes.values()) >= 1000  # the equal ones share a cell


def test_search_reads_only_the_cells_it_needs(spark, entries, index, tmp_path):
    q = asked(entries, "entry_index = 2500")
    plan = cell_index.search(index, q, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and " IN (" in plan
    read = {r[0] for r in index.entries.where(F.col("cell").isin([1, 2])).select(F.input_file_name()).distinct().collect()}
    assert read and all("/cell=1/" in f or "/cell=2/" in f for f in read)
    again = cell_index.load(spark, index_path(index))
    assert again.probes == index.probes and np.array_equal(again.centres, index.centres)


def index_path(index):
    return index.entries.inputFiles()[0].split("/entries/")[0]


def test_small_galleries_are_searched_exactly(spark, entries, tmp_path):
    few = entries.where("entry_index < 1200")
    one = cell_index.write(few, "file://" + str(tmp_path / "few"))
    assert one.exact and one.cells == 1
    q = asked(entries, "entry_index % 300 = 7")
    assert sorted(map(tuple, cell_index.search(one, q).collect())) == sorted(map(tuple, gallery.top_hits(q, few).collect()))
    with pytest.raises(ValueError):
        cell_index.write(few.where("false"), "file://" + str(tmp_path / "none"))
    assert [cell_index.cells_for(n) for n in (0, 9_999, 10_000, 1_000_000, 10**12)] == [1, 1, 100, 1000, 4096]


def test_distance_orders_vectors_of_any_length(spark):
    r = np.random.default_rng(4)
    g = [(i, "x", (r.normal(size=3) * (1 + i % 5)).tolist()) for i in range(60)]
    q = [(i, (r.normal(size=3)).tolist()) for i in range(9)]
    got = gallery.top_hits(spark.createDataFrame(q, "query_id bigint, vector array<double>"), spark.createDataFrame(g, SCHEMA), 4, size=16, metric="l2").collect()
    for i, v in q:
        d = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, _, w in g)[:4]
        mine = sorted((x["rank"], x["entry_index"], x["similarity"]) for x in got if x["query_id"] == i)
        assert [(n, j) for n, j, _ in mine] == [(n + 1, j) for n, (_, j) in enumerate(d)]
        assert np.allclose([s for *_, s in mine], [1 - x / 2 for x, _ in d])
    with pytest.raises(ValueError):
        gallery.similarities(np.zeros((1, 2)), np.zeros((1, 2)), "cosine")


def test_many_references_do_not_hide_the_rival(spark):
    r = np.random.default_rng(6)
    g = [(i, f"id_{i % 5}" if i % 11 else None, r.normal(size=4).round(1).tolist()) for i in range(300)] + [(1000 + i, "many", [1.0, 0.0, 0.0, 0.1 * i]) for i in range(8)]
    q = [(i, r.normal(size=4).tolist()) for i in range(20)] + [(77, [9.0, 0.0, 0.0, 0.0])]
    queries, entries = spark.createDataFrame(q, "query_id bigint, vector array<double>"), spark.createDataFrame(g, SCHEMA).repartition(5)
    got = {}
    for x in gallery.identity_hits(queries, entries, 3, size=32).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["entry_index"], x["identity"], round(x["similarity"], 9)))
    for i, v in q:
        best = {}
        for s, j, name in sorted((-round(float(np.dot(v, w)), 12), j, name) for j, name, w in g if name):
            best.setdefault(name, (s, j))
        want = [(n + 1, j, name, round(-s, 9)) for n, (s, j, name) in enumerate(sorted((s, j, name) for name, (s, j) in best.items())[:3])]
        assert sorted(got[i]) == want
    one = queries.where("query_id = 77").withColumn("coherence", F.lit(1.0))
    listed = gallery.identify(one, entries, 0.35).first()
    whole = gallery.identify(one, entries, 0.35, margin_scope="all").first()
    assert listed["identity"] == whole["identity"] and whole["runner_up"] is not None and whole["margin"] == pytest.approx(whole["similarity"] - whole["runner_up"])
    with pytest.raises(ValueError):
        gallery.identify(one, entries, 0.35, margin_scope="some")
