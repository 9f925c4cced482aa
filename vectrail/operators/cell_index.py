"""An inverted file over a gallery, stored as a table that is partitioned by cell.

Centres come from spherical k-means on a bounded sample, their number from the
gallery's size. Every entry lies in the cell of its nearest centre; a folder
holds a cell, in as many files as its rows need. A search looks into the
``probes`` cells nearest to a query and reads no other folder. How many that must be
is measured when the index is written: the hits of a bounded sample of entries,
found in the whole gallery, lie in so many cells with the share ``target``.

Below ``least`` entries there is one cell, and every search is exact; ``Index.exact``
tells. Entries without a comparable vector of the sample's commonest length
are not in the index, queries without one have no hits.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.operators.gallery import CELL_LEAST, TOP_K, _best_of, blocks, comparable, in_cells, top_hits
from vectrail.sources.shared import stored

#: Cells at most; sampled rows a cell and bytes of them at most; queries whose hits are looked up to set ``probes``.
MOST_CELLS, SAMPLE_ROWS, SAMPLE_BYTES, TUNED_BY = 4096, 32, 1 << 27, 256
#: Entries in one file.
FILE_ROWS = 1 << 20
COLUMNS = "entry_index bigint, identity string, vector array<double>"


@dataclass
class Index:
    """A written index. ``centres``: a row a cell; a few megabytes at most."""

    entries: DataFrame
    centres: np.ndarray
    probes: int
    rows: int

    @property
    def cells(self) -> int:
        return len(self.centres)

    @property
    def exact(self) -> bool:
        return self.cells == 1 or self.probes >= self.cells


def lowest(rows: DataFrame, key: str, n: int, of: int) -> DataFrame:
    """The ``n`` rows with the lowest hashes of their keys; only about twice as many are ordered."""
    order = F.xxhash64(F.lit(7), key)
    share = min(1.0, 2.0 * n / max(1, of))
    return rows.where(order.cast("double") <= -(2.0**63) + share * 2.0**64).orderBy(order, key).limit(n)


def sampled(rows: DataFrame, n: int, of: int) -> np.ndarray:
    """At most so many vectors of one length, sent as bytes."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"v": pa.array([np.array(v, np.float32).tobytes() for v in b.column(0).to_pylist()], pa.binary())})

    found = [bytes(r["v"]) for r in lowest(rows, "entry_index", n, of).select("vector").mapInArrow(run, "v binary").collect()]
    if not found:
        raise ValueError("an empty gallery has no index")
    size = Counter(map(len, found)).most_common(1)[0][0]
    return np.frombuffer(b"".join(v for v in found if len(v) == size), np.float32).reshape(-1, size // 4).astype(np.float64)


def fitted(v: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centres by spherical k-means; a cell that gets no row takes the row farthest from its centre."""
    length = np.linalg.norm(v, axis=1, keepdims=True)
    v = (v / np.maximum(length, 1e-12)).astype(np.float32)
    c = v[np.random.default_rng(seed).permutation(len(v))[:cells]]
    for _ in range(rounds):
        near, best = np.empty(len(v), np.int64), np.empty(len(v), np.float32)
        for at in range(0, len(v), 4096):
            s = v[at : at + 4096] @ c.T
            near[at : at + 4096], best[at : at + 4096] = s.argmax(1), s.max(1)
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.zeros_like(c)
        sums[near[order][starts]] = np.add.reduceat(v[order], starts, axis=0)
        empty = np.flatnonzero(np.bincount(near, minlength=len(c)) == 0)
        sums[empty] = v[np.argsort(best)[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float64)


def cells_for(rows: int, least: int = CELL_LEAST) -> int:
    return 1 if rows < least else max(1, min(MOST_CELLS, math.isqrt(rows)))


def write(gallery: DataFrame, path: str, cells: int | None = None, least: int = CELL_LEAST, target: float = 0.95, k: int = TOP_K) -> Index:
    """Writes the index of ``gallery(entry_index, identity, vector)`` and opens it."""
    spark = gallery.sparkSession
    rows = stored(comparable(gallery, "entry_index").select(F.col("entry_index").cast("bigint").alias("entry_index"), F.col("identity").cast("string").alias("identity"), F.col("vector").cast("array<double>").alias("vector")), "entries")
    n = rows.count()
    cells = cells or cells_for(n, least)
    first = sampled(rows, 64, n).shape[1]
    v = sampled(rows, max(64, min(SAMPLE_ROWS * cells, SAMPLE_BYTES // (4 * first))), n)
    centres = fitted(v, min(cells, len(v)))
    # by ranges, so that a cell of many rows is written by many tasks
    ordered = in_cells(rows, centres, 1).repartitionByRange("cell", "entry_index").sortWithinPartitions("cell", "entry_index")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{path}/entries")
    probes = tuned(rows, n, centres, target, k)
    table = spark.createDataFrame([(c, x.tolist(), probes, n) for c, x in enumerate(centres)], "cell int, centre array<double>, probes int, rows bigint")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    table = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])  # one row a cell
    entries = spark.read.schema(COLUMNS + ", cell int").parquet(f"{path}/entries")
    return Index(entries, np.array([r["centre"] for r in table]), table[0]["probes"], table[0]["rows"])


def tuned(rows: DataFrame, n: int, centres: np.ndarray, target: float, k: int) -> int:
    """The cells that hold the share ``target`` of the hits of a bounded sample of entries, their own
    rows not counted."""
    if len(centres) == 1:
        return 1
    some = stored(lowest(rows, "entry_index", TUNED_BY, n).select(F.col("entry_index").alias("query_id"), "vector"), "tuned-by")
    hits = top_hits(some, rows, k + 1, sizes=(TUNED_BY, n)).where("entry_index <> query_id").select("query_id", "entry_index")
    own = in_cells(rows.join(hits.select("entry_index").distinct(), "entry_index", "left_semi"), centres, 1).select("entry_index", "cell")
    found = hits.join(own, "entry_index").join(some, "query_id").select("cell", "vector")
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # a fixed number

    def run(batches):
        for b in batches:
            s = np.array(b.column(1).to_pylist()).reshape(b.num_rows, -1) @ sent.value.T
            cell = b.column(0).to_numpy()[:, None]
            mine = np.take_along_axis(s, cell, 1)
            before = (s > mine) | (s == mine) & (np.arange(s.shape[1]) < cell)
            yield pa.RecordBatch.from_arrays([pa.array(before.sum(1))], names=["before"])

    at = sorted(r["before"] for r in found.mapInArrow(run, "before bigint").collect())  # at most TUNED_BY times k
    return at[min(len(at), math.ceil(target * len(at))) - 1] + 1 if at else 1


def search(index: Index, queries: DataFrame, k: int = TOP_K, probes: int | None = None, size: int = 2048, metric: str = "ip") -> DataFrame:
    """As ``gallery.top_hits`` over the entries of the ``probes`` cells nearest to each query."""
    probes = min(probes or index.probes, index.cells)
    near = in_cells(comparable(queries, "query_id").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), index.centres, probes)
    near = stored(near, "probes")
    cells = sorted(r["cell"] for r in near.select("cell").distinct().collect())  # as many as there are cells
    entries = index.entries if len(cells) == index.cells else index.entries.where(F.col("cell").isin(cells))
    q = blocks(near.hint("rebalance", "cell").sortWithinPartitions("cell"), "query_id", size, cell="cell")
    g = blocks(entries, "entry_index", size, "identity", cell="cell")
    side = lambda x, name: x.select("cell", "dim", *[F.col(c).alias(f"{name}_{c}") for c in ("keys", "names", "matrix")])
    return _best_of(side(q, "a").join(side(g, "b"), ["cell", "dim"]).drop("cell"), k, metric)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(n_queries, n_hits, recall)``: the share of the exact hits that were found."""
    hit = exact.join(found.select("query_id", "entry_index", F.lit(1).alias("hit")), ["query_id", "entry_index"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_hits"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
