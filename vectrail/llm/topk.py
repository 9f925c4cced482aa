"""Exact top-k search by inner product over integer vectors.

Rows are packed into blocks that store their vectors column by column. Blocks
are dealt to the rows and columns of a grid, and every pair (query block,
candidate block) is one row of a join on the grid's cell: a block is copied
once for each part of the other side, not for each of its blocks, work spreads
evenly and no side is broadcast. Within a pair,
scores accumulate a group of dimensions at a time; after each group a
candidate survives while its partial score plus the largest contribution
that the remaining dimensions allow (Cauchy-Schwarz over the remaining mass)
can still reach the k-th best lower bound, and survivors are compacted. A
last window keeps each query's k best.

Float sums are exact while the norms of both vectors are below ``EXACT_NORM``.
Longer vectors have blocks of their own, where floats with an error bound only
choose the candidates whose scores are then summed in Python's integers. Ranks
are right for any finite components; a score outside 64 bits is given as null.

Vectors that are null or hold null or non-finite components take no part,
nor do rows with a null id. Ties go to the smaller id. Repeated ids count as
separate candidates, but never for their own query; a repeated query has its
own ranks each time. Vectors may differ in length: only equal lengths are
compared. Empty ones are equal, with score 0. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.llm.common import stored

SCALE = 256.0
#: Products of two such norms stay below 2^53.
EXACT_NORM = 2.0**26


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows(id BIGINT, v ARRAY<DOUBLE>)``, whole numbers, as blocks ``(block,
    dim, wide, ids, matrix)``; matrix holds int32 components, or doubles in
    wide blocks, dimension by dimension."""

    def run(batches):
        held: dict[int, list] = {}

        def flush(dim):
            ids, vectors = zip(*held.pop(dim), strict=True)
            m, ids = np.array(vectors, np.float64).reshape(len(ids), dim), np.array(ids, np.int64)
            with np.errstate(over="ignore"):
                long = ~(np.sqrt((m**2).sum(1)) < EXACT_NORM)
            for wide, kind in ((False, np.int32), (True, np.float64)):
                some = long == wide
                if some.any():
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "wide": [wide], "ids": pa.array([ids[some].tobytes()], pa.binary()), "matrix": pa.array([np.ascontiguousarray(m[some].T.astype(kind)).tobytes()], pa.binary())})

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                group = held.setdefault(len(v), [])
                group.append((i, v))
                if len(group) >= block_rows:
                    yield from flush(len(v))
        for dim in list(held):
            yield from flush(dim)

    return rows.select("id", F.col("v").cast("array<double>")).mapInArrow(run, "dim int, wide boolean, ids binary, matrix binary").withColumn("block", F.monotonically_increasing_id())


def block_best(qids, qm, cids, cm, k: int, step: int) -> list[tuple[int, int, int]]:
    """The k best candidates of one block for each query of another: (place of
    the query in its block, id, score)."""
    dims = qm.shape[0]
    cuts = [*range(0, max(1, dims), step), dims]
    # mass[j]: norm of the components from cut j on
    q_mass = [np.sqrt((qm[c:].astype(np.float64) ** 2).sum(0)) for c in cuts]
    c_mass = [np.sqrt((cm[c:].astype(np.float64) ** 2).sum(0)) for c in cuts]
    cf = cm.astype(np.float64)
    qf = qm.astype(np.float64)
    out = []
    first = cf[: cuts[1]].T @ qf[: cuts[1]]  # the first group of dimensions has every candidate
    for x in range(len(qids)):
        alive = np.flatnonzero(cids != qids[x])
        part = first[alive, x]
        for j in range(1, len(cuts)):
            if j > 1:
                part = part + qf[cuts[j - 1] : cuts[j], x] @ cf[cuts[j - 1] : cuts[j]][:, alive]
            if len(alive) > k and j < len(cuts) - 1:
                slack = q_mass[j][x] * c_mass[j][alive] + 1e-6
                bar = np.partition(part - slack, len(alive) - k)[len(alive) - k]
                stay = part + slack >= bar
                alive, part = alive[stay], part[stay]
        if not len(alive):
            continue
        if len(alive) > k:
            bar = np.partition(part, len(alive) - k)[len(alive) - k]
            stay = part >= bar
            alive, part = alive[stay], part[stay]
        order = np.lexsort((cids[alive], -part))[:k]
        out += [(x, int(cids[alive[o]]), int(part[o])) for o in order]
    return out


def wide_best(qids, qm, cids, cm, k: int) -> list[tuple[int, int, int]]:
    """``block_best`` for components of any size."""
    cf = cm.astype(np.float64)
    cf = cf / (np.abs(cf).max() or 1.0)
    c_norm = np.sqrt((cf**2).sum(0))
    error = (len(cm) + 8) * 2.0**-52
    out = []
    for x in range(len(qids)):
        alive = np.flatnonzero(cids != qids[x])
        if len(alive) > k:
            q = qm[:, x].astype(np.float64)
            q = q / (np.abs(q).max() or 1.0)
            part = q @ cf[:, alive]
            slack = error * np.sqrt((q**2).sum()) * c_norm[alive] + 1e-150  # for what is lost below the smallest float
            bar = np.partition(part - slack, len(alive) - k)[len(alive) - k]
            alive = alive[part + slack >= bar]
        whole = [int(a) for a in qm[:, x].tolist()]
        scores = [(-sum(a * int(b) for a, b in zip(whole, cm[:, c].tolist(), strict=True)), int(cids[c])) for c in alive]
        out += [(x, c, -s) for s, c in sorted(scores)[:k]]
    return out


def sort_key(score: int) -> bytes:
    """Bytes in the order of the scores, which may be longer than 64 bits."""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + raw if score >= 0 else b"\0" + bytes(255 - x for x in raw)


def grid(n_queries: int, n_candidates: int, across: int = 16, deep: int = 32) -> tuple[int, int]:
    """Parts of either side's blocks: at least ``across`` of them where there are
    as many blocks, at most ``deep`` blocks in one."""
    return tuple(max(1, min(n, max(across, -(-n // deep)))) for n in (n_queries, n_candidates))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, step: int = 16, query_rows: int = 1024, candidate_rows: int = 8192) -> DataFrame:
    """``queries`` and ``candidates``: ``(id BIGINT, v ARRAY<DOUBLE>)``. Returns
    ``(query_id, rank, vec_id, score)``."""
    q = stored(packed(queries, query_rows), "queries").select("dim", F.col("block").alias("qb"), F.col("wide").alias("qw"), F.col("ids").alias("qids"), F.col("matrix").alias("qm"))
    c = stored(packed(candidates, candidate_rows), "candidates").select("dim", F.col("block").alias("cb"), F.col("wide").alias("cw"), F.col("ids").alias("cids"), F.col("matrix").alias("cm"))
    q_parts, c_parts = grid(q.count(), c.count())
    part = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q_all = q.withColumn("qp", part("qb", q_parts)).withColumn("cp", every(c_parts))
    c_all = c.withColumn("cp", part("cb", c_parts)).withColumn("qp", every(q_parts))
    pairs = q_all.join(c_all, ["qp", "cp", "dim"]).select("dim", "qb", "qw", "qids", "qm", "cw", "cids", "cm")

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                r = b.slice(row, 1).to_pylist()[0]  # one pair at a time: its blocks are large
                qids, cids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["cids"], np.int64)
                qm, cm = (np.frombuffer(r[n], np.float64 if r[w] else np.int32).reshape(r["dim"], len(i)) for n, w, i in (("qm", "qw", qids), ("cm", "cw", cids)))
                best = wide_best(qids, qm, cids, cm, k) if r["qw"] or r["cw"] else block_best(qids, qm, cids, cm, k, step)
                if best:
                    at, c, scores = zip(*best, strict=True)
                    at = np.array(at)
                    held = pa.array([s if -(1 << 63) <= s < 1 << 63 else None for s in scores], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["qb"], np.int64)), pa.array(at.astype(np.int32)), pa.array(qids[at]), pa.array(c, pa.int64()), held, pa.array(map(sort_key, scores), pa.binary())], names=["qb", "at", "query_id", "vec_id", "score", "key"])

    best = pairs.mapInArrow(run, "qb bigint, at int, query_id bigint, vec_id bigint, score bigint, key binary")
    # block and place tell query rows apart, also those with one id
    rank = F.row_number().over(W.partitionBy("qb", "at").orderBy(F.desc("key"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``(id, v)``: floor(scale * x) of each component, whole finite vectors only.
    Fails where scale * x exceeds a double, which no 32-bit float does."""
    x = F.col(vector_col).cast("array<double>")
    finite = lambda e: F.abs(e) < float("inf")
    whole = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & finite(e))

    def floor(e):
        y = e * scale
        # doubles from 2^53 upward are whole
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).when(finite(y), y).otherwise(F.raise_error(F.lit("component too large to scale")).cast("double"))

    return table.where(whole).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, floor).alias("v"))
