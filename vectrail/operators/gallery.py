"""Gallery search with open-set decisions.

Vectors are packed into blocks of rows and dealt to a grid of parts; a part of the
queries and a part of the gallery meet in one cell of it, of bounded size, and are
multiplied in numpy by tiles; only each query's best k of a cell leave it. Nothing is
broadcast, no pair of vectors becomes a row.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD, MARGIN, TOP_K, FLOOR = 0.35, 0.05, 5, 0.7


def comparable(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a key and a vector whose components are all finite numbers."""
    v = F.col("vector").cast("array<double>")
    return rows.where(F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def blocks(rows: DataFrame, key: str, size: int, name: str = "", parts: int = 1, cell: str = "") -> DataFrame:
    """``(block, cell, dim, keys, names, matrix)`` with at most ``size`` rows each, of
    the ``comparable`` rows; only vectors of one dimension and cell share a block. Without
    a ``cell``, it is one of ``parts``, by the key alone."""
    names = F.col(name).cast("string") if name else F.lit("")
    cells = F.col(cell).cast("int") if cell else F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(parts)).cast("int")
    source = comparable(rows, key).select(F.col(key).cast("bigint").alias("k"), names.alias("n"), F.col("vector").cast("array<double>").alias("v"), cells.alias("c"))

    def run(batches):
        for b in batches:
            kinds = np.stack([pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)], axis=1)
            for dim, c in np.unique(kinds, axis=0).tolist():
                rows = b.take(pa.array(np.flatnonzero((kinds == (dim, c)).all(1))))
                for at in range(0, rows.num_rows, size):
                    part = rows.slice(at, size)
                    m = pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int32()), "dim": pa.array([dim], pa.int32()), "keys": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "names": pa.array([part.column(1).to_pylist()], pa.list_(pa.string())), "matrix": pa.array([m.astype(np.float64).tobytes()], pa.binary())})

    packed = source.mapInArrow(run, "cell int, dim int, keys array<bigint>, names array<string>, matrix binary")
    return packed.withColumn("block", F.col("cell").cast("bigint"))


def grid(rows: int, size: int, least: int = 4, deep: int = 16) -> int:
    """Parts of a side of so many rows: ``least`` of them, or more where a part
    would have over ``deep`` blocks."""
    return max(least, -(-rows // (size * deep)))


def cells(a: DataFrame, b: DataFrame, parts_a: int, parts_b: int, run, schema: str, once: bool = False) -> DataFrame:
    """``run`` over every part of ``a`` with every part of ``b``, by dimension: a block of
    either side is sent to one cell of a grid for each part of the other. ``run`` takes the
    blocks of both sides as tables, which a part's size bounds. ``once``: both sides
    are the same, and two parts meet once only."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    columns = ("dim", "keys", "names", "matrix")
    left = a.select(F.col("block").alias("ga"), *columns, every(parts_b).alias("gb"))
    right = b.select(F.col("block").alias("gb"), *[F.col(c).alias(c) for c in columns], every(parts_a).alias("ga"))  # columns of its own, as both sides may be one table
    if once:
        left, right = left.where("ga <= gb"), right.where("ga <= gb")
    names = [x.split()[0] for x in schema.split(", ")]

    def whole(x: pa.Table, y: pa.Table) -> pa.Table:
        found = list(run(x, y)) if x.num_rows and y.num_rows else []
        return pa.Table.from_batches(found) if found else pa.Table.from_batches([_nothing(names, kinds)])

    kinds = [_ARROW[x.split()[1]] for x in schema.split(", ")]
    return left.groupBy("ga", "gb", "dim").cogroup(right.groupBy("ga", "gb", "dim")).applyInArrow(whole, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _nothing(names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)


def stacked(t: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Keys, names and vectors of blocks of one dimension."""
    flat = lambda c: pc.list_flatten(t.column(c).combine_chunks())
    keys = flat("keys").to_numpy(zero_copy_only=False)
    return keys, flat("names"), np.frombuffer(b"".join(t.column("matrix").to_pylist())).reshape(len(keys), t.column("dim")[0].as_py())


#: Pairs that a task multiplies at once.
TILE = 2**21


def tiles(rows: int, columns: int) -> list[slice]:
    step = max(1, TILE // max(1, columns))
    return [slice(at, at + step) for at in range(0, rows, step)]


METRICS = ("ip", "l2")


def top_hits(queries: DataFrame, gallery: DataFrame, k: int = TOP_K, size: int = 2048, metric: str = "ip", sizes: tuple[int, int] | None = None) -> DataFrame:
    """``queries(query_id, vector)`` against ``gallery(entry_index, identity,
    vector)``: ``(query_id, rank, entry_index, identity, similarity)``, ties to
    the smaller entry. By inner product ("ip"), or by distance ("l2"), where the
    similarity is 1 - d^2 / 2; both agree on unit vectors. ``sizes``: the rows of
    either side, if known; they are else counted."""
    return ranked(_side_by_side(queries, gallery, k, size, metric, sizes), k)


def _side_by_side(queries: DataFrame, gallery: DataFrame, k: int, size: int, metric: str, sizes: tuple[int, int] | None, apart: bool = False) -> DataFrame:
    n_queries, n_gallery = sizes or (queries.count(), gallery.count())
    parts_q, parts_g = grid(n_queries, size), grid(n_gallery, size)
    q, g = blocks(queries, "query_id", size, parts=parts_q), blocks(gallery, "entry_index", size, "identity", parts_g)
    return cells(q, g, parts_q, parts_g, lambda x, y: nearest(*stacked(x)[::2], *stacked(y), k, metric, apart), HITS)


def similarities(q: np.ndarray, g: np.ndarray, metric: str = "ip") -> np.ndarray:
    """Of all pairs, at twelve decimals."""
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    s = q @ g.T
    if metric == "l2":
        s += 1 - ((q * q).sum(1)[:, None] + (g * g).sum(1)[None]) / 2
    return np.round(s, 12)


def nearest(queries: np.ndarray, q: np.ndarray, entries: np.ndarray, names: pa.Array, g: np.ndarray, k: int, metric: str = "ip", apart: bool = False):
    """Batches of HITS: each query's k best entries, or with ``apart`` the best entry of each of
    its k best identities. The k-th greatest of the maxima of groups of columns bounds a
    row's k-th best from below (with ``apart`` a group is an identity); only the few
    pairs that can reach it are multiplied in full, rounded and sorted."""
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False) if apart else np.zeros(len(entries), np.int64)
    order = np.lexsort((entries, code))
    entries, g, code, names = entries[order], g[order], code[order], names.take(pa.array(order))
    starts = np.flatnonzero(np.diff(code, prepend=-1)) if apart else np.arange(0, len(entries), max(1, min(64, len(entries) // (4 * k))))
    squares = (g * g).sum(1)
    longest = np.sqrt(max(squares.max(), (queries_squares := (q * q).sum(1)).max()))
    # a first look in single precision, with its error bound, where nothing can overflow
    kind = np.float32 if longest < 1e15 else np.float64
    slack = 4 * (q.shape[1] + 8) * float(np.finfo(kind).eps) * float(longest) ** 2 + 1e-11
    look, turned, half = q.astype(kind), np.ascontiguousarray(g.T, kind), (squares / 2).astype(kind)
    for tile in tiles(len(queries), len(entries)):
        s = look[tile] @ turned
        if metric == "l2":
            s -= half
        most = np.maximum.reduceat(s, starts, axis=1) if len(starts) < len(entries) else s
        if most.shape[1] > k:
            least = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k]
            at, o = np.divmod(np.flatnonzero(s >= (least - kind(slack))[:, None]), len(entries))  # what may be equal when rounded
        else:
            at, o = (x.ravel() for x in np.indices(s.shape))
        similar = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[tile][at[c : c + 2**16]], g[o[c : c + 2**16]]) for c in range(0, len(at), 2**16))])
        if metric == "l2":
            similar += 1 - (queries_squares[tile][at] + squares[o]) / 2
        similar = np.round(similar, 12)
        first = np.lexsort((entries[o], -similar, at))
        if apart:
            first = first[np.sort(np.unique(at[first] * (int(code[-1]) + 1) + code[o[first]], return_index=True)[1])]
        at, o, similar = at[first], o[first], similar[first]
        few = np.arange(len(at)) - np.searchsorted(at, at) < k
        yield _hit_rows(queries[tile][at[few]], entries[o[few]], names.take(pa.array(o[few])), similar[few])


HITS = "query_id bigint, entry_index bigint, identity string, similarity double"


def _hit_rows(queries: np.ndarray, entries: np.ndarray, names: pa.Array, similar: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"query_id": pa.array(queries, pa.int64()), "entry_index": pa.array(entries, pa.int64()), "identity": pa.array(names, pa.string()), "similarity": pa.array(similar, pa.float64())})


def _best_of(pairs: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """The k best hits of each query over pairs of a query block and a gallery block."""

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                r = pa.Table.from_batches([b.slice(at, 1)])
                side = lambda x, r=r: stacked(r.select([f"{x}_{c}" for c in ("keys", "names", "matrix")] + ["dim"]).rename_columns(["keys", "names", "matrix", "dim"]))
                yield from nearest(*side("a")[::2], *side("b"), k, metric)

    return ranked(pairs.mapInArrow(run, HITS), k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k first hits of each query, with their ``rank``."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_index"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "entry_index", "identity", "similarity")


def identity_hits(queries: DataFrame, gallery: DataFrame, k: int = 2, size: int = 2048, metric: str = "ip", sizes: tuple[int, int] | None = None) -> DataFrame:
    """As ``top_hits``, with the best entry only of each of the k best identities, so that many
    references of one identity cannot hide its rival. Entries without an identity
    take no part."""
    known = gallery.where("identity is not null")
    found = _side_by_side(queries, known, k, size, metric, sizes, apart=True)
    first = F.row_number().over(W.partitionBy("query_id", "identity").orderBy(F.desc("similarity"), "entry_index"))
    return ranked(found.withColumn("first", first).where("first = 1").drop("first"), k)


#: Of the cell index: cells, cells that a query looks into, rows that fit them, and entries below which it is not used.
CELLS, PROBES, CELL_SAMPLE, CELL_LEAST = 100, 16, 25_600, 10_000


def fit_cells(gallery: DataFrame, cells: int = CELLS, sample: int = CELL_SAMPLE, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of cells by spherical k-means on at most ``sample`` entries, those
    with the lowest hashes."""
    order = F.xxhash64("entry_index")
    share = 2 * sample / max(1, gallery.count())
    low = comparable(gallery, "entry_index").where(order.cast("double") <= -(2.0**63) + min(1.0, share) * 2.0**64)
    found = [r["v"] for r in low.orderBy(order, "entry_index").limit(sample).select(F.col("vector").cast("array<double>").alias("v")).collect()]
    dim = Counter(map(len, found)).most_common(1)[0][0]
    v = np.array([x for x in found if len(x) == dim], np.float64)
    r = np.random.default_rng(seed)
    c = v[r.permutation(len(v))[:cells]]
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, v)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-12, sums / np.maximum(n, 1e-12), c)  # an empty cell keeps its centre
    return c


def in_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``rows`` once for each of the ``probes`` cells nearest to their vector."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # a fixed number

    def run(batches):
        for b in batches:
            v = pc.list_flatten(b.column("__v")).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            near = np.argsort(-(v @ sent.value.T), axis=1, kind="stable")[:, :probes]
            out = b.take(pa.array(np.repeat(np.arange(b.num_rows), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(near.ravel().astype(np.int32))], names=[*out.schema.names[:-1], "cell"])

    source = rows.where(F.size("vector") == centres.shape[1]).withColumn("__v", F.col("vector").cast("array<double>"))
    return source.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def cell_hits(queries: DataFrame, gallery: DataFrame, k: int = TOP_K, cells: int = CELLS, probes: int = PROBES, size: int = 2048, least: int = CELL_LEAST) -> DataFrame:
    """As ``top_hits``, but a query is compared with the entries of the ``probes``
    nearest of ``cells`` cells only, so hits can be missed; vectors not of the
    sample's commonest dimension take no part. Below ``least`` entries the search
    is exact."""
    if gallery.count() < least:
        return top_hits(queries, gallery, k, size)
    centres = fit_cells(gallery, cells)
    by_cell = lambda x, key, n: in_cells(comparable(x, key), centres, n).repartition("cell").sortWithinPartitions("cell")
    q = blocks(by_cell(queries, "query_id", probes), "query_id", size, cell="cell")
    g = blocks(by_cell(gallery, "entry_index", 1), "entry_index", size, "identity", cell="cell")
    side = lambda x, n: x.select("cell", "dim", *[F.col(c).alias(f"{n}_{c}") for c in ("keys", "names", "matrix")])
    return _best_of(side(q, "a").join(side(g, "b"), ["cell", "dim"]).drop("cell"), k)


#: Bins of the first look at impostor similarities, and decimals kept in the second.
BINS, DIGITS = 20_000, 6


#: A similarity is a number of units of its last decimal; most are not beyond one.
UNIT = 10**DIGITS


def _impostor_cells(gallery: DataFrame, size: int, run, schema: str) -> DataFrame:
    parts = grid(gallery.count(), size)
    g = blocks(gallery, "entry_index", size, "identity", parts)
    return cells(g, g, parts, parts, run, schema, once=True)


def _impostor_units(x: pa.Table, y: pa.Table):
    """Similarities of the pairs of a cell of the grid by tiles, in units, with a function that
    overwrites what is no pair: of one identity, or within a part seen from the other side."""
    (a, a_names, left), (b, b_names, right) = stacked(x), stacked(y)
    within = x.column("ga")[0] == x.column("gb")[0]
    code = pc.fill_null(pa.concat_arrays([a_names, b_names]), "").dictionary_encode().indices.to_numpy()
    order = np.argsort(code[len(a) :], kind="stable")  # an identity's entries stand together
    b, right, of_b = b[order], right[order], code[len(a) :][order]
    low, high = np.searchsorted(of_b, code[: len(a)]), np.searchsorted(of_b, code[: len(a)], "right")
    side = 512  # a tile stays in a core's cache
    for i, j in itertools.product(range(0, len(a), side), range(0, len(b), side)):
        t = left[i : i + side] @ right[j : j + side].T
        t *= UNIT
        np.rint(t, out=t)

        def drop(value: float, t=t, i=i, j=j) -> None:
            if within:
                np.putmask(t, a[i : i + side, None] >= b[None, j : j + side], value)
            begin, end = np.maximum(low[i : i + side] - j, 0), np.minimum(high[i : i + side] - j, t.shape[1])
            for row in np.flatnonzero(begin < end).tolist():
                t[row, begin[row] : end[row]] = value

        yield t, drop


def impostors(gallery: DataFrame, size: int = 2048) -> DataFrame:
    """Similarities of entry pairs of different identities, as a histogram:
    ``(bin, n, total, largest)``, in units. A cell of the grid sends one row a bin at most;
    its sum and its greatest are with the first of them."""
    def run(x, y):
        n, total, most = np.zeros(BINS + 1, np.int64), 0.0, -np.inf
        for t, drop in _impostor_units(x, y):
            drop(np.nan)
            dropped = np.isnan(t)
            if dropped.any():
                t = t[~dropped]
            if t.size:
                total, most = total + float(t.sum()), max(most, float(t.max()))
                n += np.bincount(bins(t).ravel(), minlength=BINS + 1)
        at = np.flatnonzero(n)
        if len(at):
            first = np.arange(len(at)) == 0
            yield pa.RecordBatch.from_pydict({"bin": pa.array(at, pa.int32()), "n": n[at], "total": np.where(first, total, 0.0), "largest": np.where(first, most, -np.inf)})

    found = _impostor_cells(gallery, size, run, "bin int, n bigint, total double, largest double")
    return found.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest"))


def bins(units: np.ndarray) -> np.ndarray:
    at = units + UNIT
    at /= 2 * UNIT // BINS  # never near the next whole number, as units are whole
    np.clip(at, 0, BINS, out=at)
    return at.astype(np.int64)


def impostor_quantile(gallery: DataFrame, share: float, size: int = 2048) -> DataFrame:
    """One row ``(n_pairs, mean, largest, quantile)``; the quantile, linear between
    neighbours, of similarities at six decimals. The histogram shows the one or
    two bins that hold it; only their values are then counted."""
    rows = impostors(gallery, size).orderBy("bin").collect()  # one row a bin
    spark = gallery.sparkSession
    schema = "n_pairs bigint, mean double, largest double, quantile double"
    below = dict(zip([r["bin"] for r in rows], itertools.accumulate((r["n"] for r in rows), initial=0), strict=False))
    total = sum(r["n"] for r in rows)
    if not total:
        return spark.createDataFrame([(0, None, None, None)], schema)
    place = share * (total - 1)
    ranks = (math.floor(place), math.ceil(place))
    wanted = sorted({next(r["bin"] for r in rows if below[r["bin"]] <= k < below[r["bin"]] + r["n"]) for k in ranks})
    width = 2 * UNIT // BINS
    spans = [(-math.inf if b == 0 else b * width - UNIT, math.inf if b == BINS else (b + 1) * width - UNIT) for b in wanted]

    def run(x, y):
        for t, drop in _impostor_units(x, y):
            drop(np.nan)
            for low, high in spans:
                values, n = np.unique(t[(t >= low) & (t < high)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values + 0.0), pa.array(n, pa.int64())], names=["units", "n"])

    values = _impostor_cells(gallery, size, run, "units double, n bigint").groupBy("units").agg(F.sum("n").alias("n")).orderBy("units").collect()  # of two bins
    found: dict[int, float] = {}
    for b in wanted:
        seen = below[b]
        for r in values:
            if bins(np.array([r["units"]]))[0] == b:
                found |= {k: r["units"] / UNIT for k in ranks if seen <= k < seen + r["n"]}
                seen += r["n"]
    low, high = (found[k] for k in ranks)
    return spark.createDataFrame([(total, math.fsum(r["total"] for r in rows) / UNIT / total, max(r["largest"] for r in rows) / UNIT, low + (place - ranks[0]) * (high - low))], schema)


def calibrated_threshold(gallery: DataFrame, far: float = 1e-3, configured: float = THRESHOLD, min_pairs: int = 100) -> DataFrame:
    """One row: ``n_pairs``, ``quantile``, ``threshold``."""
    use = F.when(F.col("n_pairs") < min_pairs, F.lit(configured)).otherwise(F.greatest("quantile", F.lit(configured)))
    return impostor_quantile(gallery, 1 - far).select("n_pairs", "quantile", use.alias("threshold"))


def calibration_sample(gallery: DataFrame, most: int) -> DataFrame:
    """At most so many comparable entries, by hashes of their indices: first one of every
    identity, then others. Which they are depends on the entries alone."""
    rows = comparable(gallery, "entry_index").select("entry_index", "identity", "vector", F.md5(F.col("entry_index").cast("string").cast("binary")).alias("h"))
    first = rows.groupBy("identity").agg(F.min(F.struct("h", "entry_index")).alias("one")).select("identity", F.col("one.h").alias("first"))
    other = F.coalesce(F.col("h") != F.col("first"), F.lit(True)).cast("int")
    ordered = rows.join(first.withColumnRenamed("identity", "i"), F.col("identity").eqNullSafe(F.col("i"))).withColumn("other", other)
    return ordered.orderBy("other", "h", "entry_index").limit(most).select("entry_index", "identity", "vector")


def quantile_bounds(share: float, entries: int, doubt: float = 0.05) -> tuple[float, float]:
    """Shares whose sample quantiles enclose the true one but for the ``doubt``: Bernstein's bound
    for as many independent pairs as a sample of so many entries has."""
    k = max(1, entries // 2)
    far = math.log(2 / doubt)
    off = math.sqrt(2 * share * (1 - share) * far / k) + far / (3 * k)
    return max(0.0, share - off), min(1.0, share + off)


def sampled_threshold(gallery: DataFrame, most: int = 4096, far: float = 1e-3, configured: float = THRESHOLD, min_pairs: int = 100, doubt: float = 0.05) -> DataFrame:
    """``calibrated_threshold`` on a bounded sample: one row ``n_entries, n_pairs, quantile, low,
    high, threshold``. The whole gallery's quantile lies between ``low`` and ``high`` but for
    the ``doubt``; ``calibrated_threshold`` gives it exactly."""
    some = calibration_sample(gallery, most)
    n = some.count()
    low, high = quantile_bounds(1 - far, n, doubt)
    one, below, above = (impostor_quantile(some, s) for s in (1 - far, low, high))
    use = F.when(F.col("n_pairs") < min_pairs, F.lit(configured)).otherwise(F.greatest("quantile", F.lit(configured)))
    bounds = below.select(F.col("quantile").alias("low")).join(F.broadcast(above.select(F.col("quantile").alias("high"))))  # one row each
    return one.join(F.broadcast(bounds)).select(F.lit(n).cast("bigint").alias("n_entries"), "n_pairs", "quantile", "low", "high", use.alias("threshold"))


def identities(gallery: DataFrame) -> DataFrame:
    """Distinct, in order."""
    return gallery.where("identity is not null").select("identity").distinct().orderBy("identity")


def best_and_margin(hits: DataFrame, queries: DataFrame | None = None, shown: int = 0) -> DataFrame:
    """Each query's best hit and its lead over the first other identity in the
    list (null when the list has no other). With ``queries`` also those without a
    hit; with ``shown`` also its first so many ``candidates``."""
    # one pass over a query's hits, of which there are at most k
    ranked = F.array_sort(F.collect_list(F.struct("rank", "entry_index", "identity", "similarity")))
    g = hits.groupBy("query_id").agg(ranked.alias("hits")).withColumn("top", F.get("hits", F.lit(0)))
    other = F.get(F.filter("hits", lambda h: h["identity"] != F.col("top.identity")), F.lit(0))["similarity"]
    out = g.select("query_id", F.col("top.identity").alias("identity"), F.col("top.similarity").alias("similarity"), other.alias("runner_up"), *([F.slice("hits", 1, shown).alias("candidates")] if shown else []))
    if queries is not None:
        out = queries.select("query_id").join(out, "query_id", "left")
    return out.withColumn("margin", F.col("similarity") - F.col("runner_up"))


def decide(best: DataFrame, threshold, margin: float = MARGIN, coherence: str | None = None, floor: float = FLOOR) -> DataFrame:
    """Open-set decision; equality accepts, a missing rival is no ambiguity.
    With the name of a ``coherence`` column, rows below ``floor`` or without a
    value are rejected before all else and show no hit."""
    t = threshold if not isinstance(threshold, float) else F.lit(threshold)
    mixed = F.lit(False)
    if coherence is not None:
        mixed = F.coalesce(F.col(coherence) < floor, F.lit(True)) | F.isnan(coherence)
        shown = {"identity": F.lit(None).cast("string"), "similarity": F.lit(0.0), "margin": F.lit(0.0), "runner_up": F.lit(None).cast("double")}
        best = best.withColumns({c: F.when(mixed, x).otherwise(F.col(c)) for c, x in shown.items() if c in best.columns})
    none = F.col("identity").isNull() | F.col("similarity").isNull()
    reason = F.when(mixed, "incoherent").when(none, "no_hit").when(F.col("similarity") < t, "below_threshold").when(F.col("margin") < margin, "ambiguous")
    return best.withColumn("reason", F.coalesce(reason, F.lit("accepted"))).withColumn("accepted", F.col("reason") == "accepted")


def identify(tracks: DataFrame, gallery: DataFrame, threshold: float | Column, margin: float = MARGIN, floor: float = FLOOR, k: int = TOP_K, margin_scope: str = "top_k") -> DataFrame:
    """Open-set decisions on fused tracks ``(query_id, vector, coherence)``:
    incoherent ones are rejected without a search, those without a hit are
    reported as such, and every other decision carries its ``candidates``. The
    rival that sets the margin is the first other identity of the list, or with
    the ``margin_scope`` "all" the best other one of the whole gallery."""
    whole = tracks.where((F.col("coherence") >= floor) & ~F.isnan("coherence"))
    found = best_and_margin(top_hits(whole, gallery, k), shown=k)
    if margin_scope == "all":
        rivals = best_and_margin(identity_hits(whole, gallery)).select("query_id", F.col("runner_up").alias("rival"))
        found = found.join(rivals, "query_id").withColumn("runner_up", F.col("rival")).withColumn("margin", F.col("similarity") - F.col("rival")).drop("rival")
    elif margin_scope != "top_k":
        raise ValueError(f"no such scope: {margin_scope}")
    all_rows = tracks.select("query_id", "coherence").join(found, "query_id", "left")
    none = F.lit(None).cast(dict(found.dtypes)["candidates"])
    out = decide(all_rows, threshold, margin, "coherence", floor)
    return out.withColumn("candidates", F.when(F.col("reason") != "incoherent", F.col("candidates")).otherwise(none))


def verified(gallery: DataFrame, consent: DataFrame | None, today, waived: bool = False, compat: bool = False) -> DataFrame:
    """The gallery, if every identity has valid consent. It fails closed: on any
    gap, and where there is no consent table at all; ``waived`` lets both pass."""
    if waived:
        return gallery
    if consent is None:
        raise PermissionError("no consent table, and consent is not waived")
    gaps = [r["identity"] for r in consent_gaps(gallery, consent, today, compat).orderBy("identity").limit(5).collect()]
    if gaps:
        raise PermissionError(f"identities without valid consent, among them {gaps}")
    return gallery


def consented(consent: DataFrame, today, compat: bool = False) -> DataFrame:
    """Identities with valid consent: a row, a non-blank basis, not expired.
    ``compat`` asks for the row alone."""
    ok = consent if compat else consent.where((F.trim("basis") != "") & (F.col("expires_on").isNull() | (F.col("expires_on") >= today)))
    return ok.select("identity")


def consent_gaps(gallery: DataFrame, consent: DataFrame, today, compat: bool = False) -> DataFrame:
    """Identities without valid consent."""
    return gallery.select("identity").distinct().join(consented(consent, today, compat), "identity", "left_anti")


def consented_hits(queries: DataFrame, gallery: DataFrame, consent: DataFrame, today, compat: bool = False, **options) -> DataFrame:
    """``top_hits`` among the entries with valid consent. It fails closed: an
    entry that nothing vouches for, or without an identity, is not searched."""
    return top_hits(queries, gallery.join(consented(consent, today, compat), "identity", "left_semi"), **options)
