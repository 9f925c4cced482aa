"""Hard-negative mining by blocked dense matrix products over integer vectors.

Rows are packed into blocks of vectors. Anchor blocks go to every part of a
grid that holds candidate blocks, by an equi-join: a candidate block is copied
once for each part of the anchors (a part has ``deep`` blocks, so a small set
of anchors is one part), an anchor block once for each part of the candidates.
One float64 product gives all scores of a pair of blocks. The first pass keeps
each anchor's best rows of its own label, its positives; lists of a task are
merged as it goes, and lists of tasks by a ranked window. The second pass
multiplies again, now with the positives beside their anchors, and keeps for
each (anchor, positive) the best rows of other labels whose score lies in the
positive's window.

Float sums are exact while the norms of both vectors are below ``EXACT_NORM``,
so that scores stay below 2^53. Longer vectors have blocks of their own, where
scores are sums of Python integers; a score outside 64 bits is given as null,
its rank is right.

Rows with a null id, label or vector, or with a null or non-finite component
take no part. Ties go to the smaller id. Repeated ids count as separate
candidates, but never for an anchor with their id; a repeated anchor row has
results of its own each time. Vectors may differ in length; only equal lengths
are compared, and empty ones have score 0. An anchor without positives, and a
positive whose window holds nothing, give no rows; an empty table gives none.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.llm.common import stored
from vectrail.llm.topk import EXACT_NORM, SCALE, sort_key

LEAST = np.iinfo(np.int64).min
#: Anchors whose lists a task holds before it hands them on.
HELD_ANCHORS = 1 << 16


def labelled(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = SCALE) -> DataFrame:
    """``(id, label, v)``: floor(scale * x) of each component, of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = lambda e: F.abs(e) < float("inf")
    whole = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & finite(e))

    def floor(e):
        y = e * scale
        # doubles from 2^53 upward are whole
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).when(finite(y), y).otherwise(F.raise_error(F.lit("component too large to scale")).cast("double"))

    return table.where(whole).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.transform(x, floor).alias("v"))


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows(id, label, v)`` as blocks ``(block, dim, wide, ids, labels, matrix)``;
    the matrix holds int32 components row by row, or doubles in wide blocks."""

    def run(batches):
        held: dict[tuple, list] = {}

        def sent(key):
            dim, wide = key
            parts = held.pop(key)
            ids, labels, m = (np.concatenate([p[k] for p in parts]) for k in range(3))
            for at in range(0, len(ids), block_rows):
                some = slice(at, at + block_rows)
                arrays = ids[some], labels[some], np.ascontiguousarray(m[some].astype(np.float64 if wide else np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([wide]), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=["dim", "wide", "ids", "labels", "matrix"])

        for b in batches:
            sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                same = b.take(pa.array(np.flatnonzero(sizes == dim)))
                m = pc.list_flatten(same.column(2)).to_numpy(zero_copy_only=False).reshape(same.num_rows, dim)
                with np.errstate(over="ignore"):
                    long = ~(np.sqrt((m**2).sum(1)) < EXACT_NORM)
                ids, labels = (same.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for wide in (False, True):
                    some = long == wide
                    if some.any():
                        group = held.setdefault((dim, wide), [])
                        group.append((ids[some], labels[some], m[some]))
                        if sum(len(g[0]) for g in group) >= block_rows:
                            yield from sent((dim, wide))
        for key in list(held):
            yield from sent(key)

    return rows.select("id", "label", F.col("v").cast("array<double>")).mapInArrow(run, "dim int, wide boolean, ids binary, labels binary, matrix binary").withColumn("block", F.monotonically_increasing_id())


def block_of(r: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(r[side + n], np.int64) for n in ("ids", "labels"))
    return ids, labels, np.frombuffer(r[side + "matrix"], np.float64 if r[side + "wide"] else np.int32).reshape(len(ids), r["dim"])


def products(anchors: np.ndarray, candidates: np.ndarray, wide: bool) -> np.ndarray:
    """All scores of two blocks: exact floats, or Python integers."""
    if not wide:
        return anchors.astype(np.float64) @ candidates.astype(np.float64).T
    whole = [[[int(x) for x in v] for v in m.tolist()] for m in (anchors, candidates)]
    out = np.empty((len(anchors), len(candidates)), object)
    for i, a in enumerate(whole[0]):
        for j, c in enumerate(whole[1]):
            out[i, j] = sum(x * y for x, y in zip(a, c, strict=True))
    return out


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest as (-score, id), in order."""
    if len(scores) > k and scores.dtype != object:
        stay = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[stay], ids[stay]
    return sorted(zip([-int(s) for s in scores.tolist()], ids.tolist(), strict=True))[:k]


def joined_grid(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_candidates: int, across: int = 16, deep: int = 32) -> DataFrame:
    """Every anchor block with every candidate block of its length."""
    parts_a, parts_c = max(1, -(-n_anchors // deep)), max(1, min(n_candidates, max(across, -(-n_candidates // deep))))
    part = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    side = lambda df, s: df.select("ap", "cp", "dim", *[F.col(c).alias(s + c) for c in df.columns if c not in ("ap", "cp", "dim")])
    a = side(anchors.withColumn("ap", part(parts_a)).withColumn("cp", every(parts_c)), "a_")
    c = side(candidates.withColumn("cp", part(parts_c)).withColumn("ap", every(parts_a)), "c_")
    return a.join(c, ["ap", "cp", "dim"])


def each_pair(batches):
    """The pairs of blocks one at a time, as they are large."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


FOUND = "block bigint, at int, anchor_id bigint, label bigint, turn int, id bigint, score bigint, big binary"


def listed(lists: dict[tuple[int, int, int], list], anchors: dict[int, tuple]) -> pa.RecordBatch:
    """Rows of FOUND from lists ``(block, place, turn) -> [(-score, id)]``."""
    rows = [(b, at, anchors[b][0][at], anchors[b][1][at], turn, i, -s) for (b, at, turn), found in lists.items() for s, i in found]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    fits = [LEAST <= s < 1 << 63 for s in columns[6]]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    big = [None if f else sort_key(s) for s, f in zip(columns[6], fits, strict=True)]
    return pa.RecordBatch.from_arrays([*[pa.array(list(map(int, c)), t) for c, t in zip(columns, kinds, strict=False)], pa.array([s if f else None for s, f in zip(columns[6], fits, strict=True)], pa.int64()), pa.array(big, pa.binary())], names=["block", "at", "anchor_id", "label", "turn", "id", "score", "big"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k first of each list: scores above 64 bits, those within, those below."""
    grade = F.when(F.col("big").isNull(), 0).when(F.substring("big", 1, 1) == F.lit(b"\1"), 1).otherwise(-1)
    rank = F.row_number().over(W.partitionBy("block", "at", "turn").orderBy(F.desc("grade"), F.desc("score"), F.desc("big"), "id"))
    return found.withColumn("grade", grade).withColumn("rank", rank).where(F.col("rank") <= k).drop("grade")


def as_number(score: int | None, big: bytes | None) -> int:
    """The score, from its column or from its ``sort_key``."""
    if big is None:
        return score
    raw = big[3:] if big[0] else bytes(255 - x for x in big[3:])
    return int.from_bytes(raw, "big") * (1 if big[0] else -1)


def positives_of(pairs: DataFrame, k: int) -> DataFrame:
    """FOUND with ``rank``: each anchor's first k rows of its label."""

    def run(batches):
        lists: dict = {}
        anchors: dict[int, tuple] = {}
        for r in each_pair(batches):
            block = r["a_block"]
            if block not in anchors and sum(len(a[0]) for a in anchors.values()) >= HELD_ANCHORS:
                yield listed(lists, anchors)
                lists, anchors = {}, {}
            ids, labels, m = block_of(r, "a_")
            anchors[block] = ids, labels
            others, kinds, c = block_of(r, "c_")
            scores = products(m, c, r["a_wide"] or r["c_wide"])
            for at in range(len(ids)):
                held = lists.get((block, at, 0), [])
                take = (kinds == labels[at]) & (others != ids[at])
                if len(held) == k:
                    take &= scores[at] >= -held[-1][0]
                some = np.flatnonzero(take)
                if len(some):
                    lists[block, at, 0] = sorted(held + first(scores[at][some], others[some], k))[:k]
        yield listed(lists, anchors)

    return ranked(pairs.mapInArrow(run, FOUND), k)


def negatives_of(pairs: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """FOUND with ``rank``, ``turn`` being the positive's rank: the first k rows of
    other labels with ``low * positive <= 100 * score <= high * positive``. The
    anchor side has ``positives``: (at, rank, score, big)."""

    def run(batches):
        lists: dict = {}
        anchors: dict[int, tuple] = {}
        for r in each_pair(batches):
            block = r["a_block"]
            if block not in anchors:
                if sum(len(a[0]) for a in anchors.values()) >= HELD_ANCHORS:
                    yield listed(lists, anchors)
                    lists, anchors = {}, {}
                windows: dict[int, list] = {}
                for p in r["a_positives"]:
                    score = as_number(p["score"], p["big"])
                    windows.setdefault(p["at"], []).append((p["rank"], -(-low * score // 100), high * score // 100))
                anchors[block] = (*block_of(r, "a_"), windows)
            ids, labels, m, windows = anchors[block]
            others, kinds, c = block_of(r, "c_")
            wide = r["a_wide"] or r["c_wide"]
            scores = products(m, c, wide)
            for at, turns in windows.items():
                some = np.flatnonzero((kinds != labels[at]) & (others != ids[at]))
                line, names = scores[at][some], others[some]
                for turn, least, most in turns:
                    if least > most:
                        continue
                    held = lists.get((block, at, turn), [])
                    bar = max(least, -held[-1][0]) if len(held) == k else least
                    inside = np.flatnonzero((line >= bar) & (line <= most))
                    if len(inside):
                        lists[block, at, turn] = sorted(held + first(line[inside], names[inside], k))[:k]
        yield listed(lists, anchors)

    return ranked(pairs.mapInArrow(run, FOUND), k)


def hard_negatives(anchors: DataFrame, candidates: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchor_rows: int = 1024, candidate_rows: int = 8192) -> DataFrame:
    """``anchors`` and ``candidates``: ``(id, label, v)``. Returns ``(anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score)``; scores
    between ``low`` and ``high`` percent of the positive's count."""
    a = stored(packed(anchors.hint("rebalance"), anchor_rows), "anchors")
    c = stored(packed(candidates, candidate_rows), "candidates")
    sizes = a.count(), c.count()
    best = stored(positives_of(joined_grid(a, c, *sizes), positives), "positives")
    # at most anchor_rows * positives of them in a block
    beside = best.groupBy("block").agg(F.collect_list(F.struct("at", "rank", "score", "big")).alias("positives"))
    found = negatives_of(joined_grid(a.join(beside, "block"), c, *sizes), negatives, low, high)
    known = best.select("block", "at", F.col("rank").alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(known, ["block", "at", "turn"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
