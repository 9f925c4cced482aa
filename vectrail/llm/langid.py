"""Language identification by hierarchical discrimination.

A text becomes a vector of hashed letter trigrams (square roots of counts,
unit length). A linear model first predicts the family; within it,
one-versus-one linear support vector machines vote for the language. Both
are trained in numpy on the squared hinge loss, on at most
``per_language`` labelled documents of each language, chosen by hash among
those that are not held out. Only text and language of those rows are used.

A text that is null or has no letter, or a table without any label to learn
from, gives ``und`` with score 0. Repeated rows are each returned. Null ids
are not held out and never train; of a repeated id one text for each label
trains, the least. Of more than ``most_languages`` labels the commonest are
learned. Equal votes go to the first language by name. Languages without a
known family are a family of their own. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.llm.common import KEY, Plain, stored

DIMS = 4096
PER_LANGUAGE = 400
MOST_LANGUAGES = 200
#: Languages by family.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
}
FAMILY_OF = {x: f for f, xs in FAMILIES.items() for x in xs}
#: ASCII characters that are no letters become spaces.
ONLY_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    """Letters by Unicode: digits, fractions and letter numbers are none."""
    return any(map(str.isalpha, text or ""))


def features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not has_letter(text):
            continue
        flat = b" ".join((" " + text.lower() + " ").encode().translate(ONLY_LETTERS).split())
        x = np.frombuffer(b" " + flat + b" ", np.uint8).astype(np.uint32)
        key = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        counts = np.sqrt(np.bincount((key * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=DIMS))
        row[:] = counts / max(1e-9, np.linalg.norm(counts))
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Squared-hinge linear SVM, y in {-1, 1}, classes weighted alike; last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # all in single precision: a mixed product would copy x at every step
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w))
        grad = -2 * x.T @ (share * y * slack) + decay * w
        speed = 0.9 * speed - rate * 0.1 * grad
        w = w + speed
    return w


class Model:
    """Weights of the two levels; its size depends on the number of languages only."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = [FAMILY_OF.get(v, f"only {v}") for v in langs]
        self.families = sorted(set(family))
        self.members = {f: [v for v in self.langs if FAMILY_OF.get(v, f"only {v}") == f] for f in self.families}
        fam, lang = np.array(family), np.array(langs)
        self.top = np.stack([fit_svm(x, np.where(fam == f, 1, -1)) for f in self.families]).astype(np.float32) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = fit_svm(x[rows], np.where(lang[rows] == a, 1, -1)).astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        squash = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
        if self.top is None:
            best, sure = np.zeros(len(x), np.int64), np.ones(len(x))
        else:
            margins = x @ self.top.T
            best = margins.argmax(1)
            p = squash(margins)
            sure = p.max(1) / np.maximum(1e-9, p.sum(1))
        out, score = np.empty(len(x), object), np.zeros(len(x))
        for k, f in enumerate(self.families):
            rows, names = np.flatnonzero(best == k), self.members[f]
            if not len(rows):
                continue
            wins = np.zeros((len(rows), len(names)))
            for (a, b), w in ((p, w) for p, w in self.pairs.items() if p[0] in names):
                pa_ = squash(x[rows] @ w)
                wins[:, names.index(a)] += pa_
                wins[:, names.index(b)] += 1 - pa_
            wins = wins / max(1, len(names) - 1) if len(names) > 1 else np.ones_like(wins)
            out[rows] = np.array(names, object)[wins.argmax(1)]
            score[rows] = sure[rows] * wins.max(1)
        return list(out), np.clip(score, 0, 1)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """Train on at most ``per_language`` documents of each of at most
    ``most_languages`` languages. Only ids and labels are ranked; the texts of
    the chosen rows are then featurised on the executors, and vectors of that
    bounded sample come to the driver."""
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    usable = source.where(~held_out("__id") & F.col("__id").isNotNull() & F.col("__lang").isNotNull())
    ids = usable.select("__id", "__lang")
    # The sample has each language's lowest hashes. Only ids below a hash that about twice as many are below
    # are ranked, so a common language does not meet in one task. One row for each language, a bounded number.
    sizes = ids.groupBy("__lang").agg(F.approx_count_distinct("__id").alias("__of")).orderBy(F.desc("__of"), "__lang").limit(most_languages)
    order = F.xxhash64("__id")
    low = ids.join(F.broadcast(sizes), "__lang").where(order.cast("double") <= -(2.0**63) + F.least(F.lit(1.0), 2.0 * per_language / F.col("__of")) * 2.0**64)
    rank = F.row_number().over(W.partitionBy("__lang").orderBy(order, "__id"))
    chosen = stored(low.select("__id", "__lang").distinct().withColumn("__n", rank).where(F.col("__n") <= per_language).select("__id", "__lang"), "sample")
    texts = usable.join(chosen, ["__id", "__lang"], "left_semi").groupBy("__id", "__lang").agg(F.min("__text").alias("text")).select(F.col("__lang").alias("lang"), "text")

    def run(batches):
        for b in batches:
            x = features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    rows = texts.mapInArrow(run, "lang string, x binary").collect()
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, DIMS)
    some = x.any(axis=1)
    langs = [r[0] for r, ok in zip(rows, some, strict=True) if ok]
    return Model(x[some], langs) if langs else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row."""
    source = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    schema = T.StructType([source.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: DIMS times languages

    def run(batches):
        m = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                x = features(part.column(2).to_pylist())
                names, score = m.predict(x) if m else (["und"] * len(x), np.zeros(len(x)))
                some = x.any(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n if ok else "und" for n, ok in zip(names, some, strict=True)], pa.string()), pa.array(np.where(some, score, 0.0))], names=schema.names)

    return source.mapInArrow(run, schema)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    return identify(docs, fit(docs, id_col, text_col, lang_col, **options), id_col, text_col)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` without texts whose language cannot be told (``und``). Each row
    has its own verdict, so ids may be null or repeated."""
    plain = Plain(docs)
    rows = plain.keyed()
    found = identify(rows, fit(plain.df, plain(id_col), plain(text_col), plain(lang_col), **options), KEY, plain(text_col))
    known = found.where("lang_pred <> 'und'").select(KEY).distinct()
    return plain.named(rows.join(known, KEY, "left_semi"))
