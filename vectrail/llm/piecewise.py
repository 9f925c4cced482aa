"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of seven bytes cuts a text where it is ``-1`` modulo the block
size, so equal passages are cut alike wherever they stand. Each piece gives
one of 64 characters, and a fingerprint is ``size:pieces:pieces of twice the
size``. The block size is the smallest ``3 * 2^k`` that gives at most 64
pieces; it depends on the whole text and on nothing else. Two fingerprints are
compared where their block sizes meet (equal, or one twice the other):
likeness is 1 less the edit distance over the sum of the lengths, a changed
character counting as two edits; signatures that do not share a run of
``COMMON`` characters (or of all their characters, where they have fewer) have
likeness 0.

``neighbours`` fingerprints every row and its edited text. Rows are dealt by
ranges of ids and read in order; a partition's last row is finished in a
second step, with the first row of the next partition that has any.

Null texts count as empty; an empty text has the fingerprint ``3::``, and two
empty ones have likeness 1. Null ids come first; rows with one id are ordered
by a hash of the text. A single row is its own next row, an empty table gives
no rows. Other columns are ignored. Memory: texts are hashed in blocks of a
mebibyte; a task holds two texts besides its batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.llm.common import Stored

WINDOW = 7
MOST_PIECES = 64
SMALLEST = 3
#: Characters in a row that two signatures must share.
COMMON = 4
#: Runs of one character are cut to this length before signatures are compared.
RUN = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 20

FACTORS = np.array([pow(0x9E3779B1, k + 1, 1 << 32) for k in range(WINDOW)], np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the seven bytes that end at each place; fewer at the start."""
    wide = data.astype(np.uint32) + np.uint32(1)
    r = wide * FACTORS[0]
    for k in range(1, WINDOW):
        r[k:] += wide[:-k] * FACTORS[k]
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x85EBCA6B)
    r ^= r >> np.uint32(13)
    return r


def cuts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places behind which the smallest block size cuts, and the largest k for
    which a block size of 3 * 2^k still cuts there."""
    places, levels = [], []
    for at in range(0, len(raw), BLOCK):
        before = min(at, WINDOW - 1)
        r = rolling(np.frombuffer(raw, np.uint8, min(len(raw), at + BLOCK) - at + before, at - before))[before:]
        hit = np.flatnonzero(r % SMALLEST == SMALLEST - 1)
        turn = r[hit].astype(np.uint64) + np.uint64(1)  # a multiple of 3, at least 3
        lowest = turn & (~turn + np.uint64(1))
        places.append(hit + at)
        levels.append(np.round(np.log2(lowest.astype(np.float64))).astype(np.int64))
    return (np.concatenate(places), np.concatenate(levels)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def signature(raw: bytes, ends: np.ndarray) -> str:
    """A character for each piece; the rest behind the last cut is one, too."""
    whole = [*(ends + 1).tolist(), len(raw)]
    start, out = 0, []
    for end in whole:
        if end > start:
            out.append(ALPHABET[xxhash.xxh64_intdigest(raw[start:end]) & 63])
            start = end
    return "".join(out)


def fingerprint(raw: bytes) -> str:
    places, levels = cuts(raw)
    below = np.cumsum(np.bincount(levels, minlength=1)[::-1])[::-1]  # cuts of level k or more
    k = 0
    while k < len(below) and below[k] >= MOST_PIECES:
        k += 1
    return f"{SMALLEST << k}:{signature(raw, places[levels >= k])}:{signature(raw, places[levels > k])}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def short_runs(s: str) -> str:
    return "".join(c for i, c in enumerate(s) if i < RUN or s[i - RUN : i] != c * RUN)


def alike(a: str, b: str) -> float:
    """Of two signatures of one block size."""
    if a == b:
        return 1.0
    a, b = short_runs(a), short_runs(b)
    n = min(COMMON, len(a), len(b))
    runs = {a[i : i + n] for i in range(len(a) - n + 1)}
    if not n or not any(b[i : i + n] in runs for i in range(len(b) - n + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """Of two fingerprints: the best over the block sizes that both have."""
    if one == other:
        return 1.0
    (x, *a), (y, *b) = one.split(":"), other.split(":")
    held = {int(y) << k: s for k, s in enumerate(b)}
    both = [(s, held[int(x) << k]) for k, s in enumerate(a) if int(x) << k in held]
    # two short texts without a cut at the larger size are a piece each there; this says little
    said = [(s, t) for s, t in both if min(len(s), len(t)) > 1] or both
    return max((alike(s, t) for s, t in said), default=0.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def finished(held: list[tuple], following: str, print_of_following: str) -> tuple:
    """The columns of a row, from its own (id, text, fingerprint) and the next row's."""
    doc, text, own = held
    new = edited(text, following)
    raw = new.encode()
    other = own if new == text else print_of_following if new == following else fingerprint(raw)
    return doc, len(text), hashlib.sha256(raw).hexdigest(), own, other, likeness(own, other), likeness(own, print_of_following)


COLUMNS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Rows that a task gathers before it hands them on.
ROWS = 512


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row."""
    source = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x.as_py().encode()) for x in b.column(1)], pa.string())], names=["id", "fingerprint"])

    return source.mapInArrow(run, f"id {source.dtypes[0][1]}, fingerprint string").withColumnRenamed("id", id_col)


def compared(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints."""

    @F.udf("double", useArrow=True)
    def of(x, y):
        return None if x is None or y is None else likeness(x, y)

    return of(a, b)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has its last floor(n_chars / 2)
    code points replaced by the first as many of the next row's text, by id."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = source.schema["id"].dataType.simpleString()
    ordered = source.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        """Complete rows; and the first and the last row of the partition with their texts."""
        held, part, rows, id_type = None, 0, [], None

        def sent(rows, ends):
            found = list(zip(*rows, strict=True)) if rows else [[]] * 7
            n = len(rows) or len(ends)
            own = [pa.array(found[0], id_type), *[pa.array(c, t) for c, t in zip(found[1:], KINDS, strict=True)]] if rows else [pa.array([e[0] for e in ends], id_type), *[pa.nulls(n, t) for t in KINDS]]
            if rows:
                extra = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
            else:
                extra = [pa.array([e[c] for e in ends], t) for c, t in ((3, pa.int32()), (4, pa.string()), (1, pa.string()), (2, pa.string()))]
            return pa.RecordBatch.from_arrays([*own, *extra], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "end", "text", "print"])

        for b in batches:
            id_type = b.column(0).type
            for doc, text, at in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw = text.as_py()
                row = (doc.as_py(), raw, fingerprint(raw.encode()))
                if held is None:
                    part = at.as_py()
                    yield sent([], [(*row, part, "first")])
                else:
                    rows.append(finished(held, row[1], row[2]))
                    if len(rows) >= ROWS:
                        yield sent(rows, [])
                        rows = []
                held = row
        if rows:
            yield sent(rows, [])
        if held is not None:
            yield sent([], [(*held, part, "last")])

    found = Stored(ordered.mapInArrow(run, f"id {kind}, {COLUMNS}, part int, end string, text string, print string"), "piecewise").df
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    whole = found.where("end is null").select("id", *names)
    # two rows a partition from here on
    first = found.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    last = found.where("end = 'last'").select("id", "part", "text", "print")
    places = first.select(F.col("next").alias("part")).withColumn("next", F.lead("part").over(W.orderBy("part"))).withColumn("lowest", F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)))
    places = places.select("part", F.coalesce("next", "lowest").alias("next"))
    ends = last.join(places, "part").join(first, "next").select("id", "text", "print", "next_text", "next_print")

    def finish(batches):
        for b in batches:
            for r in b.to_pylist():
                out = finished((r["id"], r["text"], r["print"]), r["next_text"], r["next_print"])
                yield pa.RecordBatch.from_arrays([pa.array([out[0]], b.column(0).type), *[pa.array([x], t) for x, t in zip(out[1:], KINDS, strict=True)]], names=["id", *names])

    done = ends.mapInArrow(finish, f"id {kind}, {COLUMNS}")
    return whole.unionAll(done).select(F.col("id").alias(id_col), *names)
