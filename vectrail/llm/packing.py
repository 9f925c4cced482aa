"""Packing token sequences by vector best fit.

Documents are tokenised whole; one longer than a sequence is cut into full
pieces and a rest, shorter ones are never cut. Pieces are dealt at random
(by hash) to groups of bounded size, and each group packs its own bins: a
piece goes to the open bin that suits it best under every capacity: tokens,
number of pieces, and attention cost (the sum of squared lengths). Best is
by ``rule``: "norm" takes the least weighted norm of what would stay free,
"dot" the greatest weighted dot-product of demand and free capacity. A group
leaves about one part-filled bin, so the loss is that share of a group.

Tokens are a limit that nothing exceeds. The capacities for pieces and for
attention cost follow from the table: ``AIM`` times what a sequence would have
if all were full of tokens. They bind in the choice of a bin, which spreads
short pieces and cost evenly, but never add a sequence: a piece that meets
them in no open bin goes by the tokens alone to the bin that exceeds them
least, before a new bin is opened. A caller can set firm limits instead; a piece
that exceeds the limit on cost alone then has a sequence of its own.

Null or empty texts are the end token alone. Repeated rows are packed as
often as they come, and dealt by row, so they do not meet in one group. Ids
may be null or repeated and are never changed. Other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.llm.common import stored

END_ID = 0
MAX_TOKENS = 2048
#: Capacities for pieces and cost, as a multiple of the mean of sequences full of tokens.
AIM = 2.0
#: Pieces that are packed together, and sequences that they fill at least (of at most as many pieces as tokens).
GROUP_PIECES, GROUP_BINS = 8192, 256
#: Of tokens, pieces and attention cost in the choice of a bin.
WEIGHTS = (1.0, 0.05, 0.01)
#: Words whose ids a task remembers at a time.
MEMO_WORDS = 400_000
#: Characters of text whose words are looked up together.
CHUNK_CHARS = 1 << 20
#: A mark at a word's end, after an ASCII letter.
LAST_MARK = re.compile(rb"(?<=[a-z])([.,;:!?])(?=[\x20\x09-\x0d]|\Z)")


class WordIds:
    """Token ids of white-space words as little-endian 32-bit bytes. The
    vocabulary's tokens never cross white space, so a text's ids are its
    words' ids in order. It also ignores the case of A-Z and always splits a
    letter from a mark, so "The," is looked up as "the" and ",". Texts that may
    hold a special token are looked up as they are.

    Ids are remembered in two generations of ``MEMO_WORDS`` words: words in use
    move to the newer one, and the older one is dropped when that is full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
            new = words
        for w in [w for w in new if w in self.older]:
            self.memo[w] = self.older[w]
        unseen = [w.decode() for w in new if w not in self.memo]
        plain = [w for w in unseen if w.lower().isalpha()]
        odd = [w for w in unseen if not w.lower().isalpha()]
        # words of letters alone end in one end-of-word token each, so many can be encoded as one text
        for k in range(0, len(plain), 10_000):
            groups = [plain[j : j + 250] for j in range(k, min(k + 10_000, len(plain)), 250)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
                if len(ends) != len(group):
                    odd += group
                    continue
                raw = ids.tobytes()
                for w, a, z in zip(group, [0, *ends], ends, strict=False):
                    self.memo[w.encode()] = raw[a:z]
        for k in range(0, len(odd), 10_000):
            part = odd[k : k + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[w.encode()] = np.array(e.ids, "<u4").tobytes()

    def many(self, texts: list[str | None]) -> list[bytes]:
        words = []
        for text in texts:
            raw = (text or "").encode()
            words.append((raw if b"<|" in raw else LAST_MARK.sub(rb" \1", raw.lower())).split())
        self.learn(set().union(*words))
        return [b"".join(map(self.memo.__getitem__, w)) for w in words]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of every document."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([source.schema[id_col], T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]])

    def run(batches):
        ids_of = WordIds(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            first, chars, texts = 0, 0, []
            for k, value in enumerate(b.column(1)):
                texts.append(value.as_py())
                chars += len(texts[-1] or "")
                if chars < CHUNK_CHARS and k < b.num_rows - 1:
                    continue
                rows: list[tuple] = []
                owner: list[int] = []
                for n_text, ids in enumerate(ids_of.many(texts)):
                    ids += end
                    for n, a in enumerate(range(0, len(ids), 4 * max_tokens)):
                        part = ids[a : a + 4 * max_tokens]
                        owner.append(first + n_text)
                        rows.append((n, a // 4, len(part) // 4, zlib.crc32(part)))
                n, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(n, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]], names=schema.names)
                first, chars, texts = k + 1, 0, []

    return source.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, max_tokens: int, max_pieces: float, max_cost: float, weights=WEIGHTS, rule: str = "norm", firm: tuple[bool, bool] = (True, True)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first, into the best open bin. ``firm``: whether
    pieces and cost are limits, or aims that a piece may exceed rather than open a bin."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    caps = np.array([max_tokens, max_pieces, max_cost], np.float64)
    limits = np.array([True, *firm])
    free = np.empty((n, 3))  # of the open bins, as shares of the capacities
    number = np.empty(n, np.int64)
    used = np.zeros(n, np.int64)
    w = np.asarray(weights)
    n_open = n_bins = 0
    shortest = int(lengths.min()) if n else 0
    least = np.where(limits, np.array([shortest, 1, float(shortest) ** 2]) / caps, -np.inf) - 1e-12
    for x in order:
        need = np.array([lengths[x], 1, float(lengths[x]) ** 2]) / caps
        left = free[:n_open] - need
        enough = left >= -1e-12
        fits = np.flatnonzero(enough.all(axis=1))
        if len(fits):
            score = (left[fits] ** 2) @ w if rule == "norm" else -(free[fits] * need) @ w
            j = fits[np.argmin(score)]
        else:
            fits = np.flatnonzero(enough[:, limits].all(axis=1)) if not limits.all() else fits
            if len(fits):
                # the bin that goes least over an aim, of those the one that is fullest of tokens
                over = np.maximum(-left[fits][:, ~limits], 0).sum(axis=1)
                j = fits[np.lexsort((left[fits, 0], over))[0]]
            else:
                j = n_open
                free[j], number[j] = 1.0, n_bins
                n_open, n_bins = n_open + 1, n_bins + 1
        bins[x], offsets[x] = number[j], used[number[j]]
        used[number[j]] += lengths[x]
        free[j] -= need
        if (free[j] < least).any():  # nothing fits any more: close it
            n_open -= 1
            free[j], number[j] = free[n_open], number[n_open]
    return bins, offsets


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS, max_pieces: int | None = None, max_cost: float | None = None, weights=WEIGHTS, rule: str = "norm", group_pieces: int | None = None) -> DataFrame:
    """``parts``, with a column ``length``, and their ``sequence_id`` and ``offset``.
    ``max_pieces`` and ``max_cost`` are firm limits, if given; ``group_pieces`` is by
    default GROUP_PIECES, or what fills GROUP_BINS sequences where that is more."""
    parts = stored(parts, "pieces")
    n, tokens, cost = parts.agg(F.count("*"), F.sum("length"), F.sum(F.col("length").cast("double") * F.col("length"))).first()
    full = max(1, math.ceil((tokens or 0) / max_tokens))
    firm = max_pieces is not None, max_cost is not None
    max_pieces = max_pieces or max(1.0, AIM * n / full)
    max_cost = max_cost or max(1.0, AIM * (cost or 0.0) / full)
    groups = max(1, math.ceil(n / (group_pieces or max(GROUP_PIECES, math.ceil(GROUP_BINS * n / full)))))
    # by row: equal pieces are told apart; the table is stored, so a task that runs again numbers its rows alike
    row = F.monotonically_increasing_id()
    dealt = parts.withColumn("__row", row).withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("int"))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("__row")
        bins, offsets = best_fit(group["length"].to_numpy(), max_tokens, max_pieces, max_cost, weights, rule, firm)
        ids = bins + (group["__group"].to_numpy().astype(np.int64) << 32)
        return group.drop_columns(["__row", "__group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("__group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, **options) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, id_col, text_col, max_tokens), max_tokens, **options)
