"""Near-duplicate groups at a given similarity, by long SimHash fingerprints.

At a Jaccard similarity of 0.8 some 15 % of a fingerprint's bits differ, so no
split of 64 bits into blocks has a block that such pairs must share. Here the
fingerprint has ``BITS`` bits over the distinct word shingles. ``blocks`` blocks
of ``width`` bits each, drawn from it at fixed random places, are the join keys;
two texts just ``similarity`` alike agree on none of them with a probability of
at most ``MISS``. A block has about as many values as there are texts, so texts
that are not alike rarely meet. Both numbers follow from the number of texts.

Rows that meet on a key are compared where they meet, in tasks over rows sorted
by key: first by a 64-bit part of the fingerprint, which leaves few rows, then
by all bits. Similarity is estimated from the Hamming distance and both sizes:
cos = cos(pi d / BITS) estimates common / sqrt(a b), with a standard error of about
0.026 in similarity. Of the pairs that are estimated within one such error of
``similarity``, or above, a task gives for each key a spanning forest of the most alike,
not the pairs; what a group has in common it has once. A link that is
estimated less than four errors above ``similarity`` is checked on both texts' exact
sets of shingles, and counts only if they are so alike. As links are the best that a
text has in a key, one that fails leaves others only where the estimates are about as far off.

Texts of fewer words than a shingle are one shingle; texts without a word are
all alike. Copies share a fingerprint and count once in all joins. Rows are told
apart by a hash of the whole row, so ids may be null or repeated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import KEY, Plain, components, named, stored, whole_keys
from vectrail.llm.simhash import shingle_hashes

SIMILARITY, WORDS = 0.8, 5
BITS = 1024
#: Standard error of the estimate: pairs are looked at from one below the similarity, and links checked up to SURE above.
SLACK = 0.026
SURE = 4
MISS = 0.01
#: Bits of the first comparison, and the most of them that may differ: for a pair just alike, three errors over the mean.
CHECK_BITS, CHECK_LIMIT = 64, 19
LEAST_WIDTH = 20


def expanded(h: np.ndarray) -> np.ndarray:
    """BITS bits (as 64-bit words) for every hash."""
    x = h[:, None] * (np.arange(BITS // 64, dtype=np.uint64) * np.uint64(2) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def long_fingerprint(text: str | None, width: int = WORDS) -> tuple[int, bytes]:
    """The number of distinct shingles, and the majority of their bits."""
    h = np.unique(np.array(shingle_hashes(text, width), np.uint64))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 255):  # as many as a byte can count
        ones += np.add.reduce(np.unpackbits(expanded(h[k : k + 255]).view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return len(h), np.packbits(2 * ones > len(h)).tobytes()


def long_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """``(id_col, text_hash BIGINT, n INT, fp BINARY)``"""
    source = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("text_hash"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, fp = zip(*[long_fingerprint(t.as_py(), width) for t in b.column(1)], strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int32()), pa.array(fp, pa.binary())], names=["id", "text_hash", "n", "fp"])

    return source.mapInArrow(run, f"id {kind}, text_hash bigint, n int, fp binary").withColumnRenamed("id", id_col)


def plan(texts: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(blocks, width): as many values of a block as texts, about, and as many
    blocks as make a miss as rare as MISS."""
    width = max(LEAST_WIDTH, math.ceil(math.log2(max(texts, 1))) - 2)
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(math.log(MISS) / math.log1p(-((1 - differ) ** width))), width


def places(blocks: int, width: int, seed: int = 3) -> np.ndarray:
    """The bits of every block, drawn anew for each."""
    r = np.random.default_rng(seed)
    return np.stack([r.permutation(BITS)[:width] for _ in range(blocks)])


def block_keys(prints: DataFrame, blocks: int, width: int) -> DataFrame:
    """``prints(node BIGINT, fp BINARY)`` to ``(key BIGINT, node, part BIGINT)``,
    ``blocks`` rows each; ``part`` has the first bits of the fingerprint."""
    at = places(blocks, width)
    power = 1 << np.arange(width, dtype=np.int64)
    first = np.arange(blocks, dtype=np.int64) << width

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 128):
                some = b.slice(k, 128)
                raw = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(len(some), BITS // 8)
                bits = np.unpackbits(raw, axis=1)
                keys = bits[:, at].astype(np.int64) @ power + first
                node = some.column(0).to_numpy()
                part = raw[:, : CHECK_BITS // 8].copy().view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(node, blocks)), pa.array(np.repeat(part, blocks))], names=["key", "node", "part"])

    return prints.select("node", "fp").mapInArrow(run, "key bigint, node bigint, part bigint")


def alike(batches):
    """The rows of sorted ``(key, node, part)`` that have a row of their key within CHECK_LIMIT bits."""
    for t in whole_keys(batches):
        key, node, part = (t.column(n).to_numpy() for n in ("key", "node", "part"))
        part = part.view(np.uint64)
        found = np.zeros(len(key), bool)
        # a few steps to rows further on find most that are found
        left = np.arange(len(key))
        for step in range(1, 9):
            left = left[left + step < len(key)]
            left = left[key[left] == key[left + step]]
            near = left[np.bitwise_count(part[left] ^ part[left + step]) <= CHECK_LIMIT]
            found[near] = found[near + step] = True
        # the others are compared with all rows of their key behind those
        start = np.searchsorted(key, key, "left")
        end = np.searchsorted(key, key, "right")
        for x in np.flatnonzero(~found & (end - start > 9)).tolist():
            if not found[x]:
                a, z = start[x], end[x]
                near = np.flatnonzero(np.bitwise_count(part[a:z] ^ part[x]) <= CHECK_LIMIT) + a
                if len(near) > 1:  # itself is one
                    found[near] = True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[found]), pa.array(node[found])], names=["key", "node"])


def estimate(differ: np.ndarray, a, b) -> np.ndarray:
    """Jaccard similarity of sets of sizes a and b by the bits that differ."""
    common = np.clip(np.cos(np.pi * differ / BITS), 0, 1) * np.sqrt(a * b)
    return common / np.maximum(a + b - common, 1e-9)


def spanning(fp: np.ndarray, size: np.ndarray, least: float, sure: float) -> list[tuple[int, int, float]]:
    """Links ``(row, row, estimate)`` that join the rows that are ``least`` alike, by way of the most
    alike. Rows that are ``sure`` to be alike join at once, so that a group of
    those takes one comparison a row."""
    links = []
    queue, outside = [0], np.arange(1, len(fp))
    best, by = np.full(len(outside), -1.0), np.zeros(len(outside), np.int64)
    while len(outside):
        while queue and len(outside):
            x = queue.pop()
            s = estimate(np.bitwise_count(fp[outside] ^ fp[x]).sum(1, dtype=np.int64), size[outside], size[x])
            joins = s >= sure
            links += [(x, y, e) for y, e in zip(outside[joins].tolist(), s[joins].tolist(), strict=True)]
            queue += outside[joins].tolist()
            stay = ~joins
            outside, best, by, s = outside[stay], best[stay], by[stay], s[stay]
            better = s > best
            best[better], by[better] = s[better], x
        if len(outside):
            j = int(np.argmax(best))
            if best[j] >= least:
                links.append((int(by[j]), int(outside[j]), float(best[j])))
            queue = [int(outside[j])]
            outside, best, by = (np.delete(v, j) for v in (outside, best, by))
    return links


def forest(least: float, sure: float):
    """Links of the rows of each key."""

    def run(batches):
        for t in whole_keys(batches):
            key, node, n = (t.column(c).to_numpy() for c in ("key", "node", "n"))
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(len(key), -1)
            size = n.astype(np.float64)
            cuts = np.flatnonzero(np.diff(key)) + 1
            links: list[tuple] = []
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                links += [(node[a + x], node[a + y], e) for x, y, e in spanning(fp[a:z], size[a:z], least, sure)]
            if links:
                a, b, e = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(e)], names=["a", "b", "estimate"])

    return run


def jaccard(one: str | None, other: str | None, width: int = WORDS) -> float:
    """Of the exact sets of shingles."""
    a, b = (set(shingle_hashes(t, width)) for t in (one, other))
    return len(a & b) / len(a | b) if a or b else 1.0


def checked(links: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, similarity: float, width: int) -> DataFrame:
    """The links ``(a, b, estimate)`` whose texts are ``similarity`` alike; those that are sure are
    not looked up. ``nodes``: (node, text_hash) with one text of each node."""
    sure = links.where(F.col("estimate") >= similarity + SURE * SLACK).select("a", "b")
    doubtful = stored(links.where(F.col("estimate") < similarity + SURE * SLACK), "doubtful")
    needed = doubtful.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    hashed = docs.select(F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("text_hash"), named(text_col).alias("text"))
    texts = hashed.join(needed.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    texts = stored(needed.join(texts, "text_hash").select("node", "text"), "texts")
    both = doubtful.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for b in batches:
            good = pa.array([jaccard(x.as_py(), y.as_py(), width) >= similarity for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
            yield b.select([0, 1]).filter(good)

    return sure.unionAll(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"))


def edges(prints: DataFrame, texts: int, similarity: float = SIMILARITY) -> DataFrame:
    """``prints(node BIGINT, n INT, fp BINARY)``, one row for each fingerprint, to
    ``(a, b, estimate)``: links between close pairs that meet."""
    blocks, width = plan(texts, similarity)
    by_key = lambda x: x.repartition("key").sortWithinPartitions("key")
    met = stored(by_key(block_keys(prints, blocks, width)).mapInArrow(alike, "key bigint, node bigint"), "met")
    full = by_key(met.join(prints, "node").select("key", "node", "n", "fp"))
    return full.mapInArrow(forest(similarity - SLACK, similarity + SURE * SLACK), "a bigint, b bigint, estimate double").groupBy("a", "b").agg(F.max("estimate").alias("estimate"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WORDS) -> DataFrame:
    """``(id_col, node)``: rows with equal ``node`` are one near-duplicate group."""
    prints = stored(long_fingerprints(docs, id_col, text_col, width), "long")
    distinct = stored(prints.groupBy("fp").agg(F.max("n").alias("n"), F.min("text_hash").alias("text_hash")), "distinct")
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = stored(edges(distinct.select("node", "n", "fp"), distinct.count(), similarity), "links")
    roots = components(stored(checked(links, distinct.select("node", "text_hash"), docs, text_col, similarity, width), "checked"))
    grouped = stored(distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("node")), "rooted")
    return prints.join(grouped, "fp").select(id_col, "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with
    the smallest id, of those the smallest hash of the text; rows without an id
    come last. All columns stay; ids may be null or repeated."""
    plain = Plain(docs)
    rows = plain.keyed()
    found = similar_groups(rows, KEY, plain(text_col), **options).distinct()
    order = F.struct(F.isnull(plain(id_col)).alias("none"), F.col(plain(id_col)).alias("id"), F.xxhash64(plain(text_col)).alias("text"), F.col(KEY).alias("key"))
    ranked = rows.select(KEY, order.alias("order")).distinct()
    keep = found.join(ranked, KEY).groupBy("node").agg(F.min("order").alias("order")).select(F.col("order.key").alias(KEY))
    return plain.named(rows.join(keep, KEY, "left_semi").dropDuplicates([KEY]))
