"""SimHash near-duplicate groups.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles.
Two fingerprints within ``max_bits`` differing bits agree wholly on at least
``blocks - max_bits`` of ``blocks`` blocks (pigeonhole). Every choice of
that many blocks gives a join key, so each close pair meets on some key.
Fingerprints that meet on a key are compared where they meet, in tasks over rows
sorted by key, and leave as the links of a spanning forest of the close ones,
so a group of near copies never becomes pairs. Equal fingerprints are merged
before, so only distinct ones (not documents) take part.

Nulls and texts without a word have fingerprint zero and link like any
other. Repeated rows are returned as often as they come. A null ``doc_id``
is kept in the result but never names a component unless its component has
no other id (then it is null). Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.llm.common import components, stored, whole_keys

SEED = 42
CHUNK = 1 << 15  # shingles whose bits are unpacked at once


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words, A-Z in lower case."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint as an unsigned 64-bit integer."""
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = np.array(hashes[k : k + CHUNK], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id_col, fp BIGINT)``: the fingerprint's bits as a signed number."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([source.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return source.mapInArrow(run, schema)


def block_masks(blocks: int, agree: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``agree`` of ``blocks`` near-equal blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_links(fps: DataFrame, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """``(a, b)`` with a < b: pairs of the distinct values ``fps(fp)`` at most
    ``max_bits`` apart, which have the components of all such pairs. More blocks
    make more, longer and so rarer keys."""
    masks = block_masks(blocks, blocks - max_bits)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    dealt = fps.select(F.explode(keys).alias("key"), "fp").repartition("key").sortWithinPartitions("key")

    def run(batches):
        for t in whole_keys(batches):
            key, fp = t.column("key").to_numpy(), t.column("fp").to_numpy()
            bits = fp.view(np.uint64)
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            sizes = np.diff(starts, append=len(key))
            two = starts[sizes == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= max_bits]
            links = [np.stack([two, two + 1])]
            for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                outside = np.arange(a, a + n)
                while len(outside) > 1:
                    reached, outside = [int(outside[0])], outside[1:]
                    while reached and len(outside):
                        x = reached.pop()
                        near = np.bitwise_count(bits[outside] ^ bits[x]) <= max_bits
                        if near.any():
                            reached += outside[near].tolist()
                            links.append(np.stack([np.full(near.sum(), x), outside[near]]))
                            outside = outside[~near]
            one, other = np.concatenate(links, axis=1)
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[one], fp[other])), pa.array(np.maximum(fp[one], fp[other]))], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """``(id_col, fp, component_id)``: component_id is the smallest id that
    can be reached over links, the document's own included."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "prints")
    firsts = stored(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "fps")
    roots = components(close_links(firsts.select("fp"), max_bits, blocks)).withColumnRenamed("node", "fp")
    grouped = firsts.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    grouped = stored(grouped, "rooted")
    least = stored(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = stored(grouped.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")
