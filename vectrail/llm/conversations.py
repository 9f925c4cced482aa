"""Repair of conversation structure at least cost.

A conversation's rows, by turn, are edited until the initials of their roles
read ``(s?(ua)+)?``. Keep costs 0, Rerole (to user or assistant) 2, Delete 3,
Insert (an empty text of user or assistant, anywhere) 2; a truncated row that
stays adds 1; blank rows and repeated ones must go. The cheapest edits are found
by A* on the lattice of (rows read, state of the pattern). Its heuristic sums,
over the rows ahead, 3 for each one that must go and 1 for each truncated one;
no way costs less, and an edit never lowers it by more than the edit costs. The
queue is keyed (cost plus heuristic, audit), so the first way to be taken out
is, among the cheapest, the one with the ASCII-least audit.

Only small rows (ids, turns, roles, hashes of the texts, faults) are dealt by
ranges of (conversation, turn) and read in order, so a conversation of any size
lies in many partitions. It is cut into chunks of at most ``CHUNK`` rows; those of one
that lies whole in a partition and has one chunk are solved at once, any other
chunk is solved from each state of the pattern to each, and ways are joined along the
conversation. The repaired texts pass through one running SHA-256 per conversation:
such a hash is sequential, so a conversation's texts are read by one task, one row at
a time.

Null roles and texts count as one space. Null ids form one conversation; null
turns come first. Rows of one turn are ordered by role, by the first characters
of the text and by its hash; equal rows are adjacent and each counts. A row's fault
is the first that applies: blank (no character but ASCII white space), duplicate
(role and text seen earlier in the conversation, by a 128-bit hash of the text),
truncated (its last such character is none of ``.!?``). Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import Stored, named

#: Rows of a conversation that are solved together.
CHUNK = 1024
#: Characters of a text by which rows of one turn and role are ordered before its hash.
HEAD = 16
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Of the pattern: the state after each initial. 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The initial that Rerole and Insert can give.
GIVEN = ("u", "u", "a", "u")
COMPLETE = (0, 3)
FAULTS = "bdt"


def ways(initials: str, faults: str, start: int, ends: tuple[int, ...], every: bool) -> dict[int, tuple[int, str]]:
    """The best ``(cost, audit)`` from a state to the first of ``ends`` that is reached, or
    to every one that can be."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if faults[i] in "bd" else TRUNCATED if faults[i] == "t" else 0)
    queue = [(ahead[0], "", 0, start)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while queue:
        key, audit, i, q = heapq.heappop(queue)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and q in ends:
            found[q] = key, audit
            if not every or len(found) == len(ends):
                break
        cost = key - ahead[i]
        given = NEXT[q][GIVEN[q]]
        steps = [(INSERT, "I", i, given)]
        if i < n:
            steps.append((DELETE, "D", i + 1, q))
            if faults[i] not in "bd":
                more = TRUNCATED if faults[i] == "t" else 0
                steps.append((REROLE + more, "R", i + 1, given))
                kept = NEXT[q].get(initials[i])
                if kept is not None:
                    steps.append((more, "K", i + 1, kept))
        for price, name, j, p in steps:
            if (j, p) not in done:
                heapq.heappush(queue, (cost + price + ahead[j], audit + name, j, p))
    return found


def digest(text: Column) -> list[Column]:
    """Two hashes of 64 bits."""
    return [F.xxhash64(F.lit(k), text) for k in (1, 2)]


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` after damage by the row's checksum."""
    word = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(word(text_col), ".!?", "")).otherwise(word(text_col))
    role = F.when(kind == 4, "user").otherwise(word(role_col))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select(named(conv_col).alias("conv"), named(turn_col).alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _plain(rows: DataFrame) -> DataFrame:
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv", "turn", word("role").alias("role"), word("text").alias("text"))


def _ordered_by(text: Column) -> list[Column]:
    one, two = digest(text)
    return [F.substring(text, 1, HEAD).alias("head"), one.alias("d1"), two.alias("d2")]


def faulty(rows: DataFrame) -> DataFrame:
    """Small rows ``(conv, turn, role, head, d1, d2, copy, fault)``; fault is one of
    b, d, t and - (none). Equal rows are counted before they are dealt, and copies
    are made anew once it is known which row is the first with its text."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    own = F.when(bare == "", "b").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    keys = ["conv", "turn", "role", "head", "d1", "d2"]
    equal = rows.select("conv", "turn", "role", *_ordered_by(F.col("text")), own.alias("own")).groupBy(*keys, "own").agg(F.count("*").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    first = equal.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.min(turn).alias("first"))
    both = equal.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    copies = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    again = (F.col("copy") > 1) | ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return copies.select(*keys, "copy", F.when(F.col("own") == "b", "b").when(again, "d").otherwise(F.col("own")).alias("fault"))


#: What is known of a chunk; ``ways`` has a ``from,to,cost,audit`` for each pair of states.
PART = {"part": "int", "seq": "bigint", "first_turn": "bigint", "last_turn": "bigint", "turns": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "first_initial": "string", "last_initial": "string", "ways": "string"}
SOLVED = {"gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string"}
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
LEGAL = {"su", "ua", "au"}
#: Rows that a task gathers before it hands them on.
ROWS = 512


def ddl(key: str, kind: str, columns: dict[str, str]) -> str:
    return ", ".join([f"{key} {kind}", *[f"{c} {t}" for c, t in columns.items()]])


def batch(rows: list[tuple], key: str, kind: pa.DataType, columns: dict[str, str]) -> pa.RecordBatch:
    kinds = [kind, *[ARROW[t] for t in columns.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[key, *columns])


def summary(turns: list, initials: list[str], faults: str) -> tuple:
    """From ``first_turn`` to ``last_initial``."""
    known = [t for t in turns if t is not None]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return known[0] if known else None, known[-1] if known else None, len(set(known)), *map(faults.count, FAULTS), illegal, initials[0], initials[-1]


def chunk_ways(initials: list[str], faults: str, first: bool, last: bool) -> str:
    """Of a chunk that is known to be a conversation's first one, or its last, or neither."""
    ends = COMPLETE if first and last else (0, 1, 2, 3)
    found = [(p, q, cost, audit) for p in ((0,) if first else (0, 1, 2, 3)) for q, (cost, audit) in ways(initials, faults, p, ends, not (first and last)).items()]
    return ";".join(",".join(map(str, x)) for x in found)


def parts(faults: DataFrame, chunk: int) -> DataFrame:
    """``(conv, PART)``: the chunks of all conversations, those of one by (part, seq)."""
    keys = ["conv", "turn", "role", "head", "d1", "d2", "copy"]
    ordered = faults.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault", F.spark_partition_id().alias("part"))

    def run(batches):
        out: list[tuple] = []
        held: list[tuple] = []  # rows of the open chunk
        seq = 0
        begun_here = False  # whether the open conversation surely starts in this partition

        def close(last: bool):
            _, turns, initials, marks, at = zip(*held, strict=True)
            faults = "".join(marks)
            first = begun_here and seq == 0
            out.append((held[0][0], at[0], seq, *summary(turns, initials, faults), chunk_ways(initials, faults, first, last)))
            held.clear()

        kind = None
        for b in batches:
            kind = b.column(0).type
            for row in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if held and row[0] != held[0][0]:
                    close(True)
                    seq, begun_here = 0, True
                elif len(held) == chunk:
                    close(False)
                    seq += 1
                held.append(row)
            if len(out) >= ROWS:
                yield batch(out, "conv", kind, PART)
                out.clear()
        if held:
            close(False)
            yield batch(out, "conv", kind, PART)

    return ordered.mapInArrow(run, ddl("conv", dict(ordered.dtypes)["conv"], PART))


class Joined:
    """A conversation's figures and its best ways by end state, from its chunks in order.
    What all ways begin with is set apart, so that only their ends are compared."""

    def __init__(self):
        self.first_turn = self.last_turn = self.last_initial = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0]
        self.settled: list[str] = []
        self.ways: dict[int, tuple[int, str]] = {0: (0, "")}

    def add(self, r: dict) -> None:
        best: dict[int, tuple[int, str]] = {}
        for x in r["ways"].split(";"):
            p, q, cost, audit = x.split(",")
            if int(p) in self.ways:
                before, start = self.ways[int(p)]
                way = before + int(cost), start + audit
                best[int(q)] = min(best.get(int(q), way), way)
        tails = [a for _, a in best.values()]
        low, high = min(tails), max(tails)
        same = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(map(len, tails)))
        self.settled.append(low[:same])
        self.ways = {q: (cost, a[same:]) for q, (cost, a) in best.items()}
        self.illegal += r["illegal"] + (self.last_initial is not None and self.last_initial + r["first_initial"] not in LEGAL)
        self.last_initial = r["last_initial"]
        self.faults = [n + r[k] for n, k in zip(self.faults, ("blank", "duplicate", "truncated"), strict=True)]
        if r["turns"]:
            self.turns += r["turns"] - (self.last_turn == r["first_turn"])
            self.first_turn = r["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = r["last_turn"]

    def result(self) -> tuple:
        cost, tail = min(w for q, w in self.ways.items() if q in COMPLETE)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return gaps, *self.faults, self.illegal, cost, "".join([*self.settled, tail])


def solved(chunks: DataFrame) -> DataFrame:
    """``(conv, SOLVED)``. A task holds one conversation's audit at a time."""
    ordered = chunks.repartition("conv").sortWithinPartitions("conv", "part", "seq")

    def run(batches):
        out: list[tuple] = []
        conv = open_one = kind = None
        for b in batches:
            kind = b.column(0).type
            for r in b.to_pylist():
                if open_one is not None and r["conv"] != conv:
                    out.append((conv, *open_one.result()))
                    open_one = None
                conv, open_one = r["conv"], open_one or Joined()
                open_one.add(r)
            if len(out) >= ROWS:
                yield batch(out, "conv", kind, SOLVED)
                out.clear()
        if open_one is not None:
            yield batch([*out, (conv, *open_one.result())], "conv", kind, SOLVED)

    return ordered.mapInArrow(run, ddl("conv", dict(ordered.dtypes)["conv"], SOLVED))


class Repair:
    """Applies an audit to rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.give(), ""

    def give(self) -> str:
        self.at += 1
        given = GIVEN[self.state]
        self.state = NEXT[self.state][given]
        return "user" if given == "u" else "assistant"

    def row(self, role: str, text: str):
        """What stands in the row's place, with the inserts before it."""
        yield from self.inserts()
        edit = self.audit[self.at]
        if edit == "R":
            yield self.give(), text
            return
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[:1]]
            yield role, text


def repaired(rows: DataFrame, conversations: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """``rows(conv, turn, role, text)``; one row per conversation ``(conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256)``. With
    ``conversations(conv)`` also those listed there that have no row."""
    rows = _plain(rows)
    chunks = Stored(parts(faulty(rows), chunk), "chunks").df
    ids = (rows if conversations is None else conversations).select(F.col("conv").alias("c")).distinct()
    every = ids.join(solved(chunks), F.col("c").eqNullSafe(F.col("conv")), "left").select(F.col("c").alias("conv"), *[F.coalesce(n, F.lit("" if t == "string" else 0).cast(t)).alias(n) for n, t in SOLVED.items()])
    # a conversation's results stand before its rows
    keys = ["turn", "role", "head", "d1", "d2"]
    texts = rows.select("conv", "turn", "role", *_ordered_by(F.col("text")), "text", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in SOLVED.items()])
    kinds = dict(texts.dtypes)
    marks = every.select("conv", *[F.lit(None).cast(kinds[k]).alias(k) for k in [*keys, "text"]], F.lit(0).alias("kind"), *SOLVED)
    ordered = marks.unionAll(texts.select(marks.columns)).repartition("conv").sortWithinPartitions("conv", "kind", *keys).select("conv", "kind", "role", "text", *SOLVED)
    columns = SOLVED | {"repaired_sha256": "string"}

    def run(batches):
        out: list[tuple] = []
        mark, repair, sha, lines, kind = None, Repair(""), hashlib.sha256(), 0, None

        def write(found):
            nonlocal lines
            for role, text in found:
                sha.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
                lines += 1

        def close():
            write(repair.inserts())
            out.append((*mark, sha.hexdigest()))

        for b in batches:
            kind = b.column(0).type
            for conv, is_row, role, text, *values in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if is_row:
                    write(repair.row(role, text))
                    continue
                if mark is not None:
                    close()
                mark, repair, sha, lines = (conv, *values), Repair(values[-1]), hashlib.sha256(), 0
            if len(out) >= ROWS:
                yield batch(out, "conv_id", kind, columns)
                out.clear()
        if mark is not None:
            close()
            yield batch(out, "conv_id", kind, columns)

    return ordered.mapInArrow(run, ddl("conv_id", kinds["conv"], columns))
