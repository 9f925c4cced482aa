"""Rule-based document quality with cross-document line frequency.

Per document, in one pass over the whole text: word, symbol, repeated-line
and repeated-window counts, and the hashes of its normalised lines. Over the
corpus: in how many distinct documents of a host each line occurs (copies of
one text count once, so a copied document is not taken for boilerplate).
Lines above the host's limit are removed (``cleaned`` and ``keep_good`` return
the texts without them); a document is depleted, and rejected, if fewer words
are left than a document must have, or too small a share of them.

Null or empty texts have zero counts and fail the base rule. Null hosts form
one host. Repeated rows are each returned, equal ones with equal results. A line
is normalised by lowering case, joining ASCII white space and mapping digits to
0; lines without a word are never removed. Other columns, of any name, are kept
by ``cleaned`` and ``keep_good`` and ignored by ``verdicts``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.llm.common import KEY, Plain, stored

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
DIGITS = str.maketrans("0123456789", "0000000000")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate in more than this share of a host's distinct documents, and in more than this many.
HOST_SHARE = 0.05
HOST_DOCS = 10
#: A document is depleted with fewer words or a smaller share of its words left.
LEFT_WORDS = MIN_WORDS
LEFT_SHARE = 0.2


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur at least twice."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    key = code
    for k in range(1, window):
        m = n - k
        base = int(key.max()) + 1
        if base * len(numbers) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key[:m] * len(numbers) + code[k:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    inside = np.zeros(n, bool)
    for k in range(window):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def line_hash(line: str) -> int:
    """Of the normalised line."""
    return xxhash.xxh64_intdigest(b" ".join(line.lower().translate(DIGITS).encode().split()))


def without(text: str, hashes: set[int]) -> str:
    """The text without the lines of these hashes."""
    return "\n".join(x for x in text.split("\n") if not x.strip(SPACE) or line_hash(x) not in hashes)


def measure(text: str | None) -> tuple[int, int, int, int, int, Counter]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the
    words in each normalised line's occurrences, by the line's hash."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    dup = 0
    lines: Counter = Counter()
    for line in text.split("\n"):
        bare = line.strip(SPACE)
        if not bare:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        lines[line_hash(bare)] += len(bare.encode().split())
    chars = len(text) - sum(map(text.count, SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    source = docs.select(F.col(id_col), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("__text"))
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash"]
    schema = T.StructType([source.schema[id_col], T.StructField("host", T.StringType()), *[T.StructField(n, T.LongType()) for n in numbers], T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("line_words", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            for value in b.column(2):
                text = value.as_py()
                *counts, lines = measure(text)
                signed = np.fromiter(lines, np.uint64, len(lines)).view(np.int64)
                for column, x in zip(rows, [*counts, np.array([xxhash.xxh64_intdigest((text or "").encode())], np.uint64).view(np.int64)[0], signed, list(lines.values())], strict=True):
                    column.append(x)
            longs = [pa.array(c, pa.int64()) for c in rows[:6]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, *[pa.array(c, pa.list_(pa.int64())) for c in rows[6:]]], names=schema.names)

    return source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, host_share: float, host_docs: int, left_words: int, left_share: float) -> DataFrame:
    """``verdicts`` with ``removed``, the hashes of the lines to remove, or null."""
    rows = stored(measured(docs, id_col, text_col, host_col), "measured")
    lines = rows.select("row", "host", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", "text_hash", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    hosts = rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("of"))
    often = lines.groupBy("host", "line").agg(F.countDistinct("text_hash").alias("n_docs")).where(F.col("n_docs") > host_docs)
    limited = stored(often.join(hosts, "host").where(F.col("n_docs") > host_share * F.col("of")).select("host", "line"), "limited")
    removed = lines.join(limited, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("removed"))  # of one document
    out = rows.drop("lines", "line_words").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < left_words) | (left < left_share * F.col("n_words"))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "n_removed_words", (~base & ~depleted).alias("kept"), "removed")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_share: float = HOST_SHARE, host_docs: int = HOST_DOCS, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE) -> DataFrame:
    """Per row: id, the five counts, base_failed, n_removed_words, kept."""
    return judged(docs, id_col, text_col, host_col, host_share, host_docs, left_words, left_share).drop("removed")


def cleaned(docs: DataFrame, text_col: str = "text", host_col: str = "source", length_col: str = "n_chars", host_share: float = HOST_SHARE, host_docs: int = HOST_DOCS, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE, rejected: bool = True) -> DataFrame:
    """``docs`` with lines above their host's limit removed from the texts, and
    ``length_col``, if there is one, set for the texts that change; without the
    documents that are ``rejected`` unless these are asked for. Each row has its
    own verdict, so ids are not needed."""
    plain = Plain(docs)
    rows, text_at = plain.keyed(), plain.names.index(text_col)
    length_at = plain.names.index(length_col) if length_col in plain.names else None
    found = judged(rows, KEY, plain(text_col), plain(host_col), host_share, host_docs, left_words, left_share)
    found = stored((found if rejected else found.where("kept")).select(KEY, "removed").dropDuplicates([KEY]), "verdicts")
    both = rows.join(found, KEY).select(*plain.df.columns, "removed")

    def run(batches):
        for b in batches:
            texts = [without(t, {x & (1 << 64) - 1 for x in r}) for t, r in zip(b.column(text_at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            columns = b.columns[:-1]
            columns[text_at] = pa.array(texts, b.schema.field(text_at).type)
            if length_at is not None:
                columns[length_at] = pa.array([len(t) for t in texts]).cast(b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    changed = both.where("removed is not null").mapInArrow(run, plain.df.schema)
    return plain.named(both.where("removed is null").drop("removed").unionAll(changed))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """``cleaned`` documents without the rejected ones."""
    return cleaned(docs, rejected=False, **options)
