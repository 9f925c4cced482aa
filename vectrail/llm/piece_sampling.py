"""Sampled segmentations over a SentencePiece vocabulary, and decoding.

A text is cut before each space and around each line feed; no piece crosses
such a cut. Within a unit all segmentations into vocabulary pieces form a
lattice. Piece probabilities follow the vocabulary's order (Zipf), raised to
``theta``. Forward filtering sums the probability of every prefix; backward
sampling then draws the last piece, the one before it, and so on, each in
proportion to prefix times piece. The random numbers are a hash of the row's
key, the unit's number and the position, so a row's result does not depend
on partitions, batches or other rows.

Units of one length are filtered and sampled together in numpy; pieces are
found by a rolling hash. Characters outside the vocabulary, and the character
that stands for a space itself, become byte pieces, so decoding gives back
every text exactly. Null texts give null ids; empty ones an empty list.
Null keys count as 0; repeated rows have equal results. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from math import frexp, ldexp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = re.compile(r" ?[^ \n]+|[ \n]")
SPACE = "▁"  # how the vocabulary writes a space
MAX_PIECE = 16
#: Units up to this many characters are sampled in numpy, longer ones one by one.
WIDE = 20
CHUNK_CHARS = 1 << 20
BYTE_BASE = 1 << 24  # a slot that holds BYTE_BASE + code point stands for its bytes
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
BYTE_WEIGHT = 1e-7
PROBES = 4


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64"""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The vocabulary with its lookup table."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.byte_id = {}
        self.text: list[str | None] = [None] * size
        kept: list[tuple[str, int]] = []
        for k in range(size):
            s = m.id_to_piece(k)
            if m.is_byte(k):
                self.byte_id[int(s[3:5], 16)] = k
            elif not (m.is_control(k) or m.is_unknown(k) or m.is_unused(k)):
                self.text[k] = s.replace(SPACE, " ")
                # pieces of several spaces cannot occur within a unit
                if s == SPACE or SPACE not in s[1:]:
                    kept.append((s.replace(SPACE, " "), k))
        self.byte_of = {v: k for k, v in self.byte_id.items()}
        order = np.argsort([-m.get_score(k) for _, k in kept], kind="stable")
        rank = np.empty(len(kept))
        rank[order] = np.arange(len(kept))
        p = 1 / (rank + 10)
        p = (p / p.sum()) ** theta
        self.weight = {s: (k, float(w)) for (s, k), w in zip(kept, p, strict=True)}
        keys = np.array([self.key(s) for s, _ in kept], np.uint64)
        bits = 17
        while True:  # grow until linear probing finds a place for every piece
            table = np.full(1 << bits, -1, np.int32)
            ok = True
            for j, key in enumerate(keys):
                s = (int(key) * int(SPREAD) & (2**64 - 1)) >> (64 - bits)
                for probe in range(PROBES):
                    if table[(s + probe) % len(table)] < 0:
                        table[(s + probe) % len(table)] = j
                        break
                else:
                    ok = False
                    break
            if ok:
                break
            bits += 1
        self.bits, self.table, self.keys = bits, table, keys
        self.ids = np.array([k for _, k in kept], np.int64)
        self.p = p

    @staticmethod
    def key(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, id) of the pieces with these hashes; 0 and -1 where there is none."""
        slot = (h * SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.full(h.shape, -1, np.int64)
        for probe in range(PROBES):
            j = self.table[(slot + probe) & (len(self.table) - 1)]
            hit = (j >= 0) & (self.keys[j] == h)
            found = np.where(hit, j, found)
        return np.where(found >= 0, self.p[found], 0.0), np.where(found >= 0, self.ids[found], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str, theta: float = 1.0) -> Pieces:
    """Read once in a worker, not once a task."""
    return Pieces(path, theta)


def uniform(seed: np.ndarray, unit: np.ndarray, position) -> np.ndarray:
    x = mix(mix(seed ^ mix(unit.astype(np.uint64))) + np.asarray(position).astype(np.uint64))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def sample_wide(v: Pieces, chars: np.ndarray, which: np.ndarray, seed: np.ndarray, unit: np.ndarray):
    """Sample units of one length L. ``chars`` (n, L): the distinct units;
    ``which``: the distinct unit of each occurrence. Yields (occurrences,
    start, ids) for every drawn piece."""
    n, size = chars.shape
    forward = np.zeros((n, size + 1))
    forward[:, 0] = 1
    steps: list[np.ndarray] = [np.zeros(0)]
    names: list[np.ndarray] = [np.zeros(0)]
    # h[i]: hash of chars[i:j], extended by one character at every j
    h = np.zeros((n, size), np.uint64)
    for j in range(1, size + 1):
        low = max(0, j - MAX_PIECE)
        h[:, low:j] = h[:, low:j] * BASE + (chars[:, j - 1 : j].astype(np.uint64) + np.uint64(1))
        p, ids = v.find(h[:, low:j])
        lone = ids[:, -1] < 0  # one character outside the vocabulary: bytes
        p[lone, -1] = BYTE_WEIGHT
        ids[lone, -1] = BYTE_BASE + chars[lone, j - 1]
        mass = np.cumsum(forward[:, low:j] * p, axis=1)
        forward[:, j] = mass[:, -1]
        steps.append(mass)
        names.append(ids)
    at = np.full(len(which), size)
    for j in range(size, 0, -1):
        rows = np.flatnonzero(at == j)
        if not len(rows):
            continue
        low = max(0, j - MAX_PIECE)
        mass = steps[j][which[rows]]
        r = uniform(seed[rows], unit[rows], j) * mass[:, -1]
        pick = np.minimum((mass <= r[:, None]).sum(1), j - low - 1)
        at[rows] = low + pick
        yield rows, low + pick, names[j][which[rows], pick]


def sample_long(v: Pieces, s: str, seed: int, unit: int) -> list[tuple[int, int]]:
    """(start, id) of the pieces of one unit of any length, last piece first.
    Each sum is kept as a fraction and a power of two, so length does not matter."""
    n = len(s)
    forward, power = [1.0], [0]
    edges: list[list[tuple[int, int, float]]] = [[]]
    for j in range(1, n + 1):
        low = max(0, j - MAX_PIECE)
        here = [(i, *v.weight[s[i:j]]) for i in range(low, j) if s[i:j] in v.weight]
        if not here or here[-1][0] != j - 1:
            here.append((j - 1, BYTE_BASE + ord(s[j - 1]), BYTE_WEIGHT))
        top = max(power[i] for i, _, _ in here)
        here = [(i, k, ldexp(forward[i] * w, power[i] - top)) for i, k, w in here]
        f, e = frexp(sum(w for _, _, w in here))
        forward.append(f)
        power.append(top + e)
        edges.append(here)
    out, j = [], n
    while j:
        mass = np.cumsum([w for _, _, w in edges[j]])
        r = uniform(np.array([seed], np.uint64), np.array([unit]), j)[0] * mass[-1]
        i, k, _ = edges[j][min(int((mass <= r).sum()), len(mass) - 1)]
        out.append((i, k))
        j = i
    return out


def encode_many(v: Pieces, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
    """Ids of each text; the work arrays hold these texts' characters."""
    number: dict[str, int] = {}
    which, unit, row, cuts = [], [], [], [0]
    for k, text in enumerate(texts):
        units = UNIT.findall(text)
        which += [number.setdefault(u, len(number)) for u in units]
        unit.append(np.arange(len(units)))
        row.append(np.full(len(units), k))
        cuts.append(cuts[-1] + len(text))
    slots = np.full(cuts[-1], -1, np.int64)
    if which:
        which = np.array(which)
        unit, row = np.concatenate(unit), np.concatenate(row)
        distinct = list(number)
        sizes = np.array([len(u) for u in distinct])
        start = np.concatenate([[0], np.cumsum(sizes[which])[:-1]])
        size = sizes[which]
        own = np.empty(len(distinct), np.int64)
        for n in np.unique(sizes):
            members = np.flatnonzero(sizes == n)
            rows = np.flatnonzero(size == n)
            if n <= WIDE:
                own[members] = np.arange(len(members))
                chars = np.frombuffer("".join([distinct[m] for m in members]).encode("utf-32-le"), np.uint32).reshape(-1, n)
                for part in range(0, len(members), 1 << 14):  # keeps the tables small
                    some = rows[(own[which[rows]] >= part) & (own[which[rows]] < part + (1 << 14))] if len(members) > 1 << 14 else rows
                    for occ, i, ids in sample_wide(v, chars[part : part + (1 << 14)], own[which[some]] - part, seeds[row[some]], unit[some]):
                        slots[start[some[occ]] + i] = ids
            else:
                for r in rows:
                    for i, k in sample_long(v, distinct[which[r]], int(seeds[row[r]]), int(unit[r])):
                        slots[start[r] + i] = k
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        ids = slots[a:b]
        ids = ids[ids >= 0]
        odd = np.flatnonzero(ids >= BYTE_BASE)
        if len(odd):
            parts, last = [], 0
            for o in odd:
                parts += [ids[last:o], np.array([v.byte_id[x] for x in chr(int(ids[o]) - BYTE_BASE).encode()])]
                last = o + 1
            ids = np.concatenate([*parts, ids[last:]])
        out.append(ids)
    return out


def decode(v: Pieces, ids) -> str:
    """The text of any id sequence that ``encode_many`` makes."""
    out: list[str] = []
    held = bytearray()
    text, byte_of = v.text, v.byte_of
    for k in ids:
        s = text[k]
        if s is None:
            held.append(byte_of[k])
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held = bytearray()
        out.append(s)
    if held:
        out.append(held.decode("utf-8", "replace"))
    return "".join(out)


def row_seeds(keys: list, seed: int) -> np.ndarray:
    raw = [k if isinstance(k, int) else zlib.crc32(str(k).encode()) if k is not None else 0 for k in keys]
    return mix(np.array([x & (2**64 - 1) for x in raw], np.uint64) ^ mix(np.array([seed], np.uint64)))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, theta: float = 1.0, check: bool = False) -> DataFrame:
    """``(id, ids ARRAY<INT>)``; with ``check`` also ``n_pieces, n_bytes,
    ids_crc32, lossless`` after decoding again in the same task."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    checks = [T.StructField("n_pieces", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())]
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), *(checks if check else [])]
    schema = T.StructType([source.schema[id_col], *fields])

    def done(v, keys, texts):
        full = [t or "" for t in texts]
        ids = encode_many(v, full, row_seeds(keys.to_pylist(), seed))
        ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([t is None for t in texts]))]
        if check:
            same = [None if t is None else decode(v, i.tolist()) == t for t, i in zip(texts, ids, strict=True)]
            null = lambda xs, kind: pa.array([None if t is None else x for t, x in zip(texts, xs, strict=True)], kind)
            arrays += [null([len(i) for i in ids], pa.int64()), null([len(t.encode()) for t in full], pa.int64()), null([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays([keys, *arrays], names=schema.names)

    def run(batches):
        v = vocabulary(model_path, theta)
        for b in batches:
            first, chars, texts = 0, 0, []
            for k, value in enumerate(b.column(1)):
                texts.append(value.as_py())
                chars += len(texts[-1] or "")
                if chars >= CHUNK_CHARS or k == b.num_rows - 1:
                    yield done(v, b.column(0).slice(first, k + 1 - first), texts)
                    first, chars, texts = k + 1, 0, []

    return source.mapInArrow(run, schema)


def decoded(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` from ``encode``'s result."""
    source = encoded.select(id_col, ids_col)
    schema = T.StructType([source.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches):
        v = vocabulary(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x.as_py() is None else decode(v, x.as_py()) for x in b.column(1)], pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
