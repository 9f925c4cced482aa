"""Document scores by masked pseudo-likelihood.

A window network predicts every word from two words on either side: their
embeddings pass one hidden layer and a two-level softmax (class, then member
of the class) over the corpus's most frequent words and one symbol for all
others. A word behind that symbol is then spelled: its bytes, each given the
two before it, by counts over all such words of the corpus. To the network it is,
as a neighbour, its hash bucket; in windows it is itself, told apart from others of
its bucket by the likelihood of its spelling and more bits of its hash.

Beside the network stands the corpus itself: for each window, how often the
same neighbours occur in other documents, and how often around the same word.
Where they occur, their shares are mixed into the network's probability, with
more weight the more often they do. This table has a row for every distinct
window, so it grows with the corpus; it is counted by a shuffle and never
gathered anywhere. A document never counts for itself, but its copies do. The
score is the sum over its words of the log-probability given the neighbours.

Word counts cover the whole corpus (partial counts in tasks, then a shuffle).
Texts are turned into word ids once. Distinct texts are dealt by hash to groups
of about ``GROUP_WORDS`` words, one stored row each, which training, counting and
scoring read, so that results do not depend on how the input lies in files.
Training predicts every word of every distinct text once: each of ``rounds``
rounds takes every ``rounds``-th word, offset by the text. Each group takes
gradient steps on those from the weights sent out; weights are summed by task,
then in a tree, weighted by words. Only the vocabulary, the spelling counts and
the weights, of fixed size, come to the driver.

Null or empty texts, and texts without a word, have zero words, sum 0 and
a null mean. Repeated rows are each scored, alike. Ids are only carried. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import Stored, stored

CLASSES, MEMBERS = 32, 32
VOCAB = CLASSES * MEMBERS  # id 0: any other word
EDGE = VOCAB  # stands outside the text
#: Ids above EDGE are other words, by hash; they differ as neighbours and are one outcome.
BUCKETS = 1024
SYMBOLS = VOCAB + 1 + BUCKETS
#: Rows of the spelling table: hashes of two bytes. Its columns are the next byte; a space ends a word.
SPELL_ROWS = 4096
SPELL_PRIOR = 0.1
SIDE = 2
EMBED, HIDDEN = 8, 16
BATCH = 8192
#: Positions scored at once, of one document or many.
SCORE_POSITIONS = 8192
FLUSH_WORDS = 300_000
#: Words of a group of texts, and of windows that one task counts, about.
GROUP_WORDS, BUCKET_WORDS = 1_000_000, 2_000_000
#: How often a window's neighbours must be seen elsewhere to weigh as much as the network.
KAPPA = 4.0
#: Sums of weights that meet in one task.
FAN_IN = 64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word BINARY, n BIGINT)`` over all documents."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for value in b.column(0):
                held.update(words_of(value.as_py()))
                if len(held) > FLUSH_WORDS:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return docs.select(text_col).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The VOCAB - 1 most frequent words, and the share of each id in the corpus."""
    top = counts.orderBy(F.desc("n"), "word").limit(VOCAB - 1).collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    n = np.zeros(VOCAB)
    n[1 : len(top) + 1] = [r["n"] for r in top]
    n[0] = total - n.sum()
    return [bytes(r["word"]) for r in top], (n + 1) / (n + 1).sum()


def spelling_cells(joined: bytes) -> np.ndarray:
    """The spelling table's cell of each byte after the first, where words are
    set between single spaces."""
    x = np.frombuffer(joined, np.uint8)
    before = x[:-1].astype(np.uint32)
    earlier = np.concatenate([before[:1], before[:-1]])
    earlier[before == 32] = 32  # nothing before the word counts
    row = (earlier << 8 | before) * np.uint32(0x9E3779B1) >> np.uint32(20)
    return (row % SPELL_ROWS).astype(np.int64) * 256 + x[1:]


def spelling(counts: DataFrame, words: list[bytes]) -> np.ndarray:
    """Log-probabilities of the bytes of all words but ``words``, by cell."""
    known = counts.sparkSession.sparkContext.broadcast(set(words))  # a fixed number

    def run(batches):
        n = np.zeros(SPELL_ROWS * 256)
        for b in batches:
            rare = [(w, k) for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if w not in known.value]
            if rare:
                weight = np.repeat(np.array([k for _, k in rare], np.float64), [len(w) + 1 for w, _ in rare])
                n += np.bincount(spelling_cells(b" " + b" ".join(w for w, _ in rare) + b" "), weight, len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], names=["at", "n"])

    found = counts.select("word", "n").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    n = np.full(SPELL_ROWS * 256, SPELL_PRIOR)
    n[found["at"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    n = n.reshape(SPELL_ROWS, 256)
    return np.log(n / n.sum(1, keepdims=True)).astype(np.float32).ravel()


class Network:
    """Ids are dealt to classes in turn, so that frequent words spread over them.
    Without ``spelling``, words outside the vocabulary are told apart as neighbours only."""

    def __init__(self, words: list[bytes], share: np.ndarray, seed: int = 11, spelling: np.ndarray | None = None):
        self.spelling = spelling
        self.number = {w: k + 1 for k, w in enumerate(words)}
        r = np.random.default_rng(seed)
        table = share.reshape(MEMBERS, CLASSES).T  # class = id % CLASSES, member = id // CLASSES
        self.p = {
            "e": r.normal(0, 0.1, (SYMBOLS, EMBED)),
            "w": r.normal(0, 0.15, (2 * SIDE * EMBED, HIDDEN)),
            "b": np.zeros(HIDDEN),
            "c": r.normal(0, 0.1, (HIDDEN, CLASSES)),
            "cb": np.log(table.sum(1)),
            "m": r.normal(0, 0.1, (CLASSES, HIDDEN, MEMBERS)),
            "mb": np.log(table / table.sum(1, keepdims=True)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def coded(self, text: str | None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The words' ids, the words outside the vocabulary, and 32 bits of their hashes."""
        words = words_of(text)
        number = self.number.get
        ids = np.fromiter(map(number, words, repeat(0)), np.int16, len(words))
        rare = np.flatnonzero(ids == 0)
        others = [words[k] for k in rare.tolist()]
        digest = xxhash.xxh32_intdigest
        hashes = np.fromiter(map(digest, others), np.uint32, len(others))
        ids[rare] = VOCAB + 1 + hashes % np.uint32(BUCKETS)
        return ids, others, hashes

    def numbered(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        return self.coded(text)[:2]

    def ids(self, text: str | None) -> np.ndarray:
        return self.numbered(text)[0]

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """The log-probability of each word's spelling."""
        if self.spelling is None or not words:
            return np.zeros(len(words), np.float32)
        p = self.spelling[spelling_cells(b" " + b" ".join(words) + b" ")]
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.add.reduceat(p, np.concatenate([[0], ends[:-1]]))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """A column for each position: sums over classes are then over rows, which numpy does fast."""
        x = self.p["w"].T @ self.p["e"][context].reshape(len(context), -1).T
        x += self.p["b"][:, None]
        return np.tanh(x, out=x)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        group, member = outcome(target)
        order = np.argsort(group, kind="stable")  # classes in a row
        group, member = group[order], member[order]
        cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        h = self.hidden(context[order])
        z = self.p["c"].T @ h
        z += self.p["cb"][:, None]
        found = z[group, np.arange(len(group))] - log_sum(z)
        for g in range(CLASSES):
            a, b = cuts[g], cuts[g + 1]
            if a < b:
                z = self.p["m"][g].T @ h[:, a:b]
                z += self.p["mb"][g][:, None]
                found[a:b] += z[member[a:b], np.arange(b - a)] - log_sum(z)
        out = np.empty_like(found)
        out[order] = found
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float, memory: dict) -> None:
        """One Adagrad step on the mean negative log-probability."""
        n, p = len(target), self.p
        group, member = outcome(target)
        order = np.argsort(group, kind="stable")
        context, group, member = context[order], group[order], member[order]
        cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        x = p["e"][context].reshape(n, -1)
        h = self.hidden(context)
        d = soft(p["c"].T @ h + p["cb"][:, None])
        d[group, np.arange(n)] -= 1
        d *= np.float32(1 / n)
        grads = {"c": h @ d.T, "cb": d.sum(1), "m": np.zeros_like(p["m"]), "mb": np.zeros_like(p["mb"])}
        dh = p["c"] @ d
        for g in range(CLASSES):
            a, b = cuts[g], cuts[g + 1]
            if a < b:
                q = soft(p["m"][g].T @ h[:, a:b] + p["mb"][g][:, None])
                q[member[a:b], np.arange(b - a)] -= 1
                q *= np.float32(1 / n)
                grads["m"][g], grads["mb"][g] = h[:, a:b] @ q.T, q.sum(1)
                dh[:, a:b] += p["m"][g] @ q
        dz = dh * (1 - h * h)
        grads["w"], grads["b"] = (dz @ x).T, dz.sum(1)
        dx = (dz.T @ p["w"].T).reshape(-1, EMBED)
        # the rows of each symbol together, then summed
        flat = context.ravel()
        by = np.argsort(flat, kind="stable")
        symbols = flat[by]
        starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        grads["e"] = np.zeros_like(p["e"])
        grads["e"][symbols[starts]] = np.add.reduceat(dx[by], starts, axis=0)
        for k, g in grads.items():
            if k not in memory:
                memory[k] = np.full_like(p[k], 1e-8)
            memory[k] += g * g
            p[k] -= np.float32(rate) * g / np.sqrt(memory[k])


def outcome(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and member."""
    ids = np.where(ids > EDGE, 0, ids).astype(np.int16)
    return ids % np.int16(CLASSES), ids // np.int16(CLASSES)


def log_sum(z: np.ndarray) -> np.ndarray:
    """Of each column; the classes' scores stay far below what a float can hold once shifted by their largest."""
    top = z.max(0)
    return top + np.log(np.exp(z - top).sum(0))


def soft(z: np.ndarray) -> np.ndarray:
    z = z - z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def contexts(ids: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The SIDE ids on either side of each position (of those in ``at``)."""
    edge = np.full(SIDE, EDGE, np.int16)
    wide = np.concatenate([edge, ids, edge])
    at = np.arange(len(ids)) if at is None else at
    return np.stack([wide[at + k] for k in range(2 * SIDE + 1) if k != SIDE], axis=1)


KEYS = ["h1", "h2"]


def text_keys(text_col: str) -> list:
    """128 bits of hashes of a text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def packed(docs: DataFrame, network: Network, groups: int, text_col: str = "text") -> DataFrame:
    """One row for each of ``groups`` groups of distinct texts: ``(g, keys,
    lengths, copies, ids, marks)``, all but g as bytes. ids has the texts' word
    ids (16 bits) one after another, marks 16 bits of each word outside the
    vocabulary, in order."""
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a fixed number of words and weights

    def encode(batches):
        net = sent.value
        again: Counter = Counter()
        first: set = set()
        names = [*KEYS, "copies", "ids", "marks"]
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                keys, ids, others, hashes = [], [], [], []
                for h1, h2, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if (h1, h2) in first:  # copies within a task are counted, not sent
                        again[h1, h2] += 1
                        continue
                    first.add((h1, h2))
                    coded = net.coded(text)
                    keys.append((h1, h2, 1))
                    for held, x in zip((ids, others, hashes), coded, strict=True):
                        held.append(x)
                if keys:
                    # spelled together: texts are short
                    marks = marked(net.spelled([w for o in others for w in o]), np.concatenate(hashes))
                    cuts = np.cumsum([len(o) for o in others])[:-1]
                    rows = zip(*keys, strict=True), [i.astype("<i2").tobytes() for i in ids], [m.tobytes() for m in np.split(marks, cuts)]
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64() if j < 3 else pa.binary()) for j, (n, c) in enumerate(zip(names, (*rows[0], *rows[1:]), strict=True))})
        if again:
            keys = list(again)
            yield pa.RecordBatch.from_pydict({"h1": [k[0] for k in keys], "h2": [k[1] for k in keys], "copies": [again[k] for k in keys], "ids": pa.array([None] * len(keys), pa.binary()), "marks": pa.array([None] * len(keys), pa.binary())})

    def pack(key, table):
        h = np.stack([table.column(n).to_numpy() for n in KEYS], axis=1)
        order = np.lexsort((h[:, 1], h[:, 0]))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]).any(1)])
        copies = np.add.reduceat(table.column("copies").to_numpy()[order], np.flatnonzero(new))
        ids, marks = table.column("ids").to_pylist(), table.column("marks").to_pylist()
        # of a text's rows one with ids: the first in the order of the keys
        chosen: list[int] = []
        for place, is_new in zip(order.tolist(), new.tolist(), strict=True):
            if is_new:
                chosen.append(place)
            elif ids[chosen[-1]] is None:
                chosen[-1] = place
        lengths = np.array([len(ids[c]) // 2 for c in chosen], np.int64)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "keys": [h[order][new].tobytes()], "lengths": [lengths.tobytes()], "copies": [copies.tobytes()], "ids": [b"".join(ids[c] for c in chosen)], "marks": [b"".join(marks[c] for c in chosen)]})

    rows = docs.select(*text_keys(text_col), F.col(text_col)).mapInArrow(encode, "h1 bigint, h2 bigint, copies bigint, ids binary, marks binary")
    return rows.groupBy(F.pmod(F.xxhash64(*KEYS), F.lit(groups)).cast("int").alias("g")).applyInArrow(pack, "g int, keys binary, lengths binary, copies binary, ids binary, marks binary")


class Group:
    """The texts of one packed row, in one line with SIDE edges before each and after the last."""

    def __init__(self, row: dict):
        self.g = row["g"]
        self.keys = np.frombuffer(row["keys"], np.int64).reshape(-1, 2)
        self.lengths, self.copies = (np.frombuffer(row[n], np.int64) for n in ("lengths", "copies"))
        self.ids, self.marks = np.frombuffer(row["ids"], "<i2"), np.frombuffer(row["marks"], "<u2")
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.at = np.arange(len(self.ids)) + SIDE * (self.doc + 1)
        self.line = np.full(len(self.ids) + SIDE * (len(self.lengths) + 1), EDGE, np.int16)
        self.line[self.at] = self.ids

    def contexts(self, at: np.ndarray) -> np.ndarray:
        return np.stack([self.line[at + k] for k in range(-SIDE, SIDE + 1) if k], axis=1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Of a window's 56 bits those that stand for the word.
WORD_BITS = np.uint64(20)


def seven_bytes(words: np.ndarray) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def from_seven_bytes(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return wide.view("<u8").ravel()


#: A word outside the vocabulary is kept in 16 bits: 9 for how likely its spelling is, 7 of its hash.
MARK_BITS = 7
#: Log-probabilities by the first 9 bits: steps of a quarter to 96, then steps of 5 %.
LEVELS = -np.concatenate([np.arange(384) / 4, 96 * (65_000 / 96) ** (np.arange(128) / 127)])


def marked(spelled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The 16 bits of words that are so likely spelled."""
    cost = -np.asarray(spelled)
    level = np.rint(4 * cost)
    far = cost >= 95.8
    if far.any():
        level[far] = 384 + np.rint(127 * np.log(np.maximum(cost[far], 96) / 96) / np.log(65_000 / 96)).clip(0, 127)
    level = level.astype(np.uint16)
    return (level << np.uint16(MARK_BITS) | (hashes // np.uint32(BUCKETS)).astype(np.uint16) % np.uint16(1 << MARK_BITS)).astype("<u2")


def unmarked(marks: np.ndarray) -> np.ndarray:
    return LEVELS[marks >> np.uint16(MARK_BITS)]


def word_codes(group: Group) -> np.ndarray:
    """What tells the words of a group apart: their ids, and of words outside the vocabulary, which
    share an id with others of their bucket, also the likelihood of their spelling with its mark."""
    codes = group.ids.astype(np.uint64)
    codes[group.ids > EDGE] += (group.marks.astype(np.uint64) + np.uint64(1)) << np.uint64(16)
    return codes


class Windows:
    """The distinct windows of a group: 36 bits of the neighbours' hash, then 20
    of the word's code; a text has each once. ``bucket`` says where one is counted: by
    other bits, of which there are the more the larger the corpus."""

    def __init__(self, group: Group, buckets: int):
        h = np.full(len(group.at), 0x9E3779B97F4A7C15, np.uint64)
        codes = word_codes(group)
        line = np.full(len(group.line), EDGE, np.uint64)
        line[group.at] = codes
        for k in range(-SIDE, SIDE + 1):
            if k:
                h = mixed(h + line[group.at + k])
        near = h >> np.uint64(28)
        self.word = near << WORD_BITS | mixed(h ^ mixed(codes)) >> np.uint64(44)
        own = mixed(group.doc.astype(np.uint64) + np.uint64(1))
        once, at = distinct(self.word ^ own)  # one position of each text's windows; which of them has a position
        first, inverse = distinct(self.word[once])
        self.words = self.word[once][first]
        self.place = inverse[at]  # in words, of each position
        self.weights = np.bincount(inverse, group.copies[group.doc[once]], len(self.words)).astype(np.uint32)
        self.bucket = (mixed(h[once][first] + np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(self.bucket.astype(np.uint16) if buckets < 1 << 16 else self.bucket, kind="stable")
        self.near_own, self.once, self.at = near ^ own, once, at

    def parts(self):
        """(bucket, places in ``words``) of each bucket with words."""
        b = self.bucket[self.order]
        cuts = np.flatnonzero(np.diff(b)) + 1
        for part in np.split(self.order, cuts) if len(b) else ():
            yield int(self.bucket[part[0]]), part

    def own_neighbours(self) -> np.ndarray:
        """For each position the words that its own text has between the same neighbours."""
        inverse = distinct(self.near_own[self.once])[1]
        return np.bincount(inverse)[inverse][self.at] if len(inverse) else np.zeros(0, np.int64)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, in an order that only the values decide,
    and which value each place has. Values are told apart by the bits of a hash
    that a 64-bit number has beside a place, so that plain numbers can be sorted:
    44 for a million values."""
    bits = np.uint64(max(1, int(len(x)).bit_length()))
    places = np.uint64((1 << int(bits)) - 1)
    packed = np.sort(mixed(x + np.uint64(1)) & ~places | np.arange(len(x), dtype=np.uint64))
    order = (packed & places).astype(np.int64)
    packed >>= bits
    new = np.ones(len(x), bool)
    new[1:] = packed[1:] != packed[:-1]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def window_counts(groups: DataFrame, buckets: int) -> DataFrame:
    """``(g, bucket, around, within)``: for a group's windows of a bucket, in its order,
    how many texts of the corpus have the same neighbours with any and with the
    same word. A window that is common in a group is sent once, with its count."""

    def send(batches):
        for b in batches:
            for row in range(b.num_rows):
                group = Group(b.slice(row, 1).to_pylist()[0])
                w = Windows(group, buckets)
                parts = list(w.parts())
                for k in range(0, len(parts), 256):
                    some = parts[k : k + 256]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([n for n, _ in some], pa.int64()), "g": pa.array([group.g] * len(some), pa.int32()), "words": pa.array([seven_bytes(w.words[p]) for _, p in some], pa.binary()), "weights": pa.array([w.weights[p].tobytes() for _, p in some], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        raw = table.column("words").to_pylist()
        words, weights = from_seven_bytes(b"".join(raw)), np.frombuffer(b"".join(table.column("weights").to_pylist()), np.uint32)
        distinct, inverse = np.unique(words, return_inverse=True)
        within = np.bincount(inverse, weights, len(distinct))
        near = distinct >> WORD_BITS
        start = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
        around = np.repeat(np.add.reduceat(within, start), np.diff(np.concatenate([start, [len(near)]])))
        cuts = np.cumsum([len(x) // 7 for x in raw])[:-1]
        split = lambda x: pa.array([p.tobytes() for p in np.split(x[inverse].astype(np.uint32), cuts)], pa.binary())
        return pa.table({"g": table.column("g"), "bucket": table.column("bucket"), "around": split(around), "within": split(within)})

    return groups.mapInArrow(send, "bucket bigint, g int, words binary, weights binary").groupBy("bucket").applyInArrow(count, "g int, bucket bigint, around binary, within binary")


def positions(raw, n: int, turn: int, rounds: int) -> np.ndarray:
    """The words of a text that a round predicts; the rounds together take each once."""
    return np.arange((xxhash.xxh32_intdigest(raw) + turn) % rounds, n, rounds)


def summed(parts: DataFrame) -> tuple[np.ndarray, float] | None:
    """The sum of ``(part BIGINT, w BINARY, n DOUBLE)`` by a tree of tasks, at most FAN_IN rows each."""

    def add(table: pa.Table) -> pa.Table:
        w = sum(np.frombuffer(x, np.float64) for x in table.sort_by("part").column("w").to_pylist())
        return pa.table({"part": [table.column("part")[0].as_py() // FAN_IN], "w": pa.array([w.tobytes()], pa.binary()), "n": [float(sum(table.column("n").to_pylist()))]})

    parts = stored(parts, "weights")
    while parts.count() > FAN_IN:
        parts = stored(parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("at")).applyInArrow(add, "part bigint, w binary, n double"), "weights")
    rows = parts.orderBy("part").collect()
    return (sum(np.frombuffer(r["w"], np.float64) for r in rows), sum(r["n"] for r in rows)) if rows else None


def train(groups: DataFrame, network: Network, rounds: int = 2, rate: float = 0.05) -> Network:
    """Average what every group of ``packed`` learns, starting from the weights sent out."""
    spark = groups.sparkSession
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(network.flat())

        def run(batches, sent=sent, turn=turn):
            for b in batches:
                for row in range(b.num_rows):
                    group = Group(b.slice(row, 1).to_pylist()[0])
                    if not len(group.ids):
                        continue
                    own = Network([], np.ones(VOCAB) / VOCAB).load(sent.value)
                    memory: dict = {}
                    ends = np.cumsum(group.lengths)
                    chosen = np.concatenate([a + positions(group.ids[a:z].tobytes(), z - a, turn, rounds) for a, z in zip((ends - group.lengths).tolist(), ends.tolist(), strict=True)])
                    for k in range(0, len(chosen), BATCH):
                        at = chosen[k : k + BATCH]
                        own.step(group.contexts(group.at[at]), group.ids[at], rate, memory)
                    w = own.flat().astype(np.float64) * len(group.ids)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([group.g], pa.int64()), "w": pa.array([w.tobytes()], pa.binary()), "n": [float(len(group.ids))]})

        total = summed(groups.mapInArrow(run, "part bigint, w binary, n double"))
        if total:
            network.load(total[0] / total[1])
    return network


def word_scores(network: Network, group: Group) -> np.ndarray:
    """The network's log-probability of each word of a group."""
    out = np.empty(len(group.ids))
    for k in range(0, len(group.ids), SCORE_POSITIONS):
        out[k : k + SCORE_POSITIONS] = network.log_probabilities(group.contexts(group.at[k : k + SCORE_POSITIONS]), group.ids[k : k + SCORE_POSITIONS])
    out[group.ids > EDGE] += unmarked(group.marks)
    return out


def remembered(log_p: np.ndarray, around: np.ndarray, within: np.ndarray) -> np.ndarray:
    """The network's log-probabilities mixed with the shares of other documents' windows."""
    seen = around > 0
    share = around[seen] / (around[seen] + KAPPA)
    out = log_p.copy()
    out[seen] = np.log((1 - share) * np.exp(log_p[seen]) + share * np.clip(within[seen] / around[seen], 0, 1) + 1e-300)
    return out


SCORES = "h1 bigint, h2 bigint, n_words bigint, log_probability double"


def score(groups: DataFrame, network: Network, counts: DataFrame | None = None, buckets: int = 1) -> DataFrame:
    """``(h1, h2, n_words, log_probability)`` of the distinct texts of ``packed``,
    by the network alone or with ``window_counts``."""
    sent = groups.sparkSession.sparkContext.broadcast(network)

    def scored(group: Group, log_p: np.ndarray) -> pa.Table:
        return pa.table({"h1": group.keys[:, 0], "h2": group.keys[:, 1], "n_words": group.lengths, "log_probability": np.bincount(group.doc, log_p, len(group.lengths))})

    def alone(batches):
        for b in batches:
            for row in range(b.num_rows):
                group = Group(b.slice(row, 1).to_pylist()[0])
                yield from scored(group, word_scores(sent.value, group)).to_batches()

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left.to_pylist()[0])
        w = Windows(group, buckets)
        found = {b: (x, y) for b, x, y in zip(*[right.column(n).to_pylist() for n in ("bucket", "around", "within")], strict=True)}
        around, within = np.zeros(len(w.words)), np.zeros(len(w.words))
        for bucket, part in w.parts():
            around[part], within[part] = (np.frombuffer(x, np.uint32) for x in found[bucket])
        # other documents only: without this text's own windows, of one copy
        return scored(group, remembered(word_scores(sent.value, group), around[w.place] - w.own_neighbours(), within[w.place] - 1))

    if counts is None:
        return groups.mapInArrow(alone, SCORES)
    return groups.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(both, SCORES)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_words, log_probability, mean_log_probability)`` of every row."""
    counts = Stored(word_counts(docs, text_col), "words")
    words, share = vocabulary(counts.df)
    total = counts.df.agg(F.sum("n")).first()[0] or 0
    network = Network(words, share, spelling=spelling(counts.df, words))
    counts.drop()
    buckets = max(1, math.ceil(total / BUCKET_WORDS))
    groups = stored(packed(docs, network, max(1, math.ceil(total / GROUP_WORDS)), text_col), "groups")
    network = train(groups, network, **options)
    found = stored(score(groups, network, window_counts(groups, buckets), buckets), "scores")
    out = docs.select(F.col(id_col), *text_keys(text_col)).join(found, KEYS)
    return out.select(id_col, "n_words", "log_probability", F.try_divide("log_probability", "n_words").alias("mean_log_probability"))
