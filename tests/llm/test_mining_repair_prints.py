"""Hard negatives, conversation repair and piecewise fingerprints against plain versions."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.llm import catalog, conversations, negatives, piecewise

SF = "/root/testdata/sf0.001"


# --- hard negatives


def mined(rows, low=30, high=90):
    """In Python integers. rows: (id, label, whole numbers)."""
    out = []
    for a, kind, v in rows:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, c) for i, c, w in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == kind][:5]:
            some = [(i, n) for n, i, c in scored if c != kind and low * -s <= 100 * -n <= high * -s]
            fits = lambda x: x if -(2**63) <= x < 2**63 else None
            out += [(a, p, k + 1, i, fits(-s), fits(-n)) for k, (i, n) in enumerate(some[:10])]
    return sorted(out, key=str)


def test_negatives_match_plain_version(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(3), [float(r.randrange(-40, 60)) for _ in range(6)]) for i in range(0, 400, 5)]
    rows += [(100, 1, [1.0] * 6), (700, 0, [0.0] * 6), (800, 1, []), (801, 1, []), (802, 0, []), (900, 2, [3.0, 4.0]), (7, 2, rows[0][2])]
    df = spark.createDataFrame(rows, "id bigint, label bigint, v array<double>").repartition(5)
    for sizes in ((1024, 8192), (2, 3)):
        got = negatives.hard_negatives(df.where("id % 100 = 0"), df, anchor_rows=sizes[0], candidate_rows=sizes[1])
        assert sorted(map(tuple, got.collect()), key=str) == mined(rows)


def test_negatives_of_long_vectors(spark):
    big = [(0, 1, [2.0**70, 3.0]), (100, 1, [-(2.0**60), 1.0]), (1, 1, [2.0**71, 1.0]), (2, 1, [5.0, 2.0]), (3, 2, [2.0**70, 9.0]), (4, 2, [2.0**69, 9.0]), (5, 2, [2.0, 0.0]), (6, 2, [-(2.0**64), 4.0]), (8, 2, [2.0**40, 2.0**40]), (200, 1, [9.0, 5.0]), (9, 2, [4.0, 3.0]), (10, 1, [7.0, 7.0])]
    df = spark.createDataFrame(big, "id bigint, label bigint, v array<double>")
    want = mined([(i, c, [int(x) for x in v]) for i, c, v in big])
    got = sorted(map(tuple, negatives.hard_negatives(df.where("id % 100 = 0"), df).collect()), key=str)
    assert got == want and len(want) > 3


def test_negatives_leave_out_rows_without_a_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0], 5), (1, 1, [1.0, 0.5], 5), (2, 2, [0.5, 0.5], 5), (3, None, [1.0, 1.0], 5), (4, 2, None, 5), (5, 2, [nan, 1.0], 5), (6, 2, [inf, 1.0], 5), (None, 2, [1.0, 1.0], 5), (8, 2, [None, 1.0], 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>, block bigint")
    kept = negatives.labelled(df)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2]
    assert [tuple(r) for r in negatives.hard_negatives(kept.where("id % 100 = 0"), kept).collect()] == [(0, 1, 1, 2, 256 * 256 + 256 * 128, 2 * 256 * 128)]
    assert negatives.hard_negatives(kept.where("false"), kept.where("false")).count() == 0


# --- conversations


def cheapest(initials, faults):
    """The least (cost, audit) by a table of all states, shortest ways first."""
    n, least = len(initials), {(0, 0): (0, "")}
    for i in range(n + 1):
        for _ in range(4):  # inserts
            for q in range(4):
                if (i, q) in least:
                    p = {0: 2, 1: 2, 2: 3, 3: 2}[q]
                    cost, audit = least[i, q]
                    new = cost + 2, audit + "I"
                    least[i, p] = min(least.get((i, p), new), new)
        if i == n:
            break
        for q in range(4):
            if (i, q) not in least:
                continue
            cost, audit = least[i, q]
            late = faults[i] == "t"
            moves = [("D", 3, q)]
            if faults[i] not in "bd":
                moves.append(("R", 2 + late, {0: 2, 1: 2, 2: 3, 3: 2}[q]))
                p = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initials[i]))
                if p is not None:
                    moves.append(("K", int(late), p))
            for name, price, p in moves:
                new = cost + price, audit + name
                least[i + 1, p] = min(least.get((i + 1, p), new), new)
    return min(least[n, q] for q in (0, 3) if (n, q) in least)


SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """rows: (conv, turn, role, text) of the table before damage."""
    by = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, found in by.items():
        found = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: conversations.HEAD].encode()))
        seen, marks = set(), ""
        for _, role, text in found:
            bare = text.rstrip(SPACE)
            marks += "b" if not bare.strip(SPACE) else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in found]
        cost, audit = cheapest(initials, marks)
        turns = {t for t, _, _ in found if t is not None}
        lines, q, at = [], 0, 0
        for c in audit:
            following = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}[q]
            if c in "IR":
                lines.append(f"{following[0]}:{found[at][2] if c == 'R' else ''}")
                q = following[1]
            elif c == "K":
                lines.append(f"{found[at][1]}:{found[at][2]}")
                q = {"s": 1, "u": 2, "a": 3}[initials[at]]
            at += c != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df, **options):
    got = conversations.repaired(conversations.damaged(df), df.select(F.col("conv_id").alias("conv")), **options).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_cheapest_edits_are_found():
    r = random.Random(5)
    for n in (0, 1, 2, 3, 4, 5, 9, 30):
        for _ in range(150):
            initials = [r.choice("suauaua x") for _ in range(n)]
            faults = "".join(r.choice("---tbd") for _ in range(n))
            ((_, best),) = conversations.ways(initials, faults, 0, conversations.COMPLETE, False).items()
            assert best == cheapest(initials, faults)
            # and chunk by chunk
            size, whole = r.randrange(1, 6), conversations.Joined()
            for at in range(0, n, size):
                some = initials[at : at + size], faults[at : at + size]
                figures = dict(zip(list(conversations.PART)[2:-1], conversations.summary([0] * len(some[0]), *some), strict=True))
                whole.add(figures | {"ways": conversations.chunk_ways(*some, at == 0, False)})
            if n:
                assert whole.result()[-2:] == best


def test_small_lattice_against_every_audit():
    """All audits up to a length, so that ties go to the ASCII-least one."""
    for initials in itertools.product("sua", repeat=2):
        for faults in itertools.product("-tb", repeat=2):
            best = None
            for n in range(7):
                for audit in itertools.product("DIKR", repeat=n):
                    if sum(c != "I" for c in audit) != 2:
                        continue
                    q, at, cost, good = 0, 0, 0, True
                    for c in audit:
                        given = 3 if q == 2 else 2
                        if c == "I":
                            q, cost = given, cost + 2
                            continue
                        mark, role = faults[at], initials[at]
                        at += 1
                        good &= c == "D" or mark != "b"
                        if c == "D":
                            cost += 3
                        elif c == "R":
                            q, cost = given, cost + 2 + (mark == "t")
                        else:
                            p = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role))
                            good &= p is not None
                            q, cost = p or 0, cost + (mark == "t")
                    if good and q in (0, 3):
                        best = min(best or (99, ""), (cost, "".join(audit)))
            ((_, found),) = conversations.ways(initials, "".join(faults), 0, conversations.COMPLETE, False).items()
            assert found == best


def test_whole_table_matches_plain_repair(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = {r["conv_id"]: tuple(r)[1:] for r in catalog.queries()["op12_conversation_repair"](spark, SF).collect()}
    assert got == plain_repair(rows) and len(got) >= 20


def odd_rows():
    r = random.Random(9)
    texts = ["Fine.", "cut off", "", " \t", None, "Why?\n", "x", "Fine. ", "é!", "." * 300, "word " * 200 + "end"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(texts)) for c in (1, 2, None) for t in [None, *range(30)] for _ in range(r.randrange(3))]
    rows += [(5, None, "user", "Hi."), (5, None, "user", "Hi."), (6, -(2**40), "user", "Hi."), (6, 2**40, "assistant", "Yes."), (7, 12, "user", None)]
    rows += [(8, t, ("user", "assistant")[t % 2], f"Line {t % 50}.") for t in range(300)] + [(8, 17, "user", "same.")] * 40
    return rows


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 7, 1])
def test_odd_conversations(spark, chunk):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv int").repartition(4)
    assert repaired(df, chunk=chunk) == plain_repair(rows)


def test_conversations_without_rows(spark):
    dropped = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    assert repaired(df) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(df.where("false")) == {}


# --- piecewise fingerprints


def scalar_fingerprint(raw: bytes) -> str:
    """One byte at a time."""
    turns = []
    for i in range(len(raw)):
        r = sum((raw[i - k] + 1) * pow(0x9E3779B1, k + 1, 1 << 32) for k in range(min(i + 1, 7))) & 0xFFFFFFFF
        r ^= r >> 15
        r = r * 0x85EBCA6B & 0xFFFFFFFF
        turns.append(r ^ r >> 13)

    def pieces(size):
        out, start = "", 0
        for i, r in enumerate(turns):
            if r % size == size - 1 or i == len(raw) - 1:
                out += piecewise.ALPHABET[piecewise.xxhash.xxh64_intdigest(raw[start : i + 1]) & 63]
                start = i + 1
        return out

    size = 3
    while sum(r % size == size - 1 for r in turns) >= 64:
        size *= 2
    return f"{size}:{pieces(size)}:{pieces(2 * size)}"


def scalar_likeness(a: str, b: str) -> float:
    """Edits by the table of prefixes."""

    def alike(x, y):
        if x == y:
            return 1.0
        for c in piecewise.ALPHABET:
            while c * 4 in x:
                x = x.replace(c * 4, c * 3)
            while c * 4 in y:
                y = y.replace(c * 4, c * 3)
        n = min(4, len(x), len(y))
        if not n or not any(x[i : i + n] in y for i in range(len(x) - n + 1)):
            return 0.0
        line = list(range(len(y) + 1))
        for i, c in enumerate(x):
            new = [i + 1]
            for j, d in enumerate(y):
                new.append(min(line[j + 1] + 1, new[j] + 1, line[j] + (0 if c == d else 2)))
            line = new
        return 1 - line[-1] / (len(x) + len(y))

    if a == b:
        return 1.0
    (s, *p), (t, *q) = a.split(":"), b.split(":")
    s, t = int(s), int(t)
    pairs = [(p[0], q[0]), (p[1], q[1])] if s == t else [(p[1], q[0])] if 2 * s == t else [(p[0], q[1])] if s == 2 * t else []
    pairs = [x for x in pairs if min(map(len, x)) > 1] or pairs
    return max((alike(*x) for x in pairs), default=0.0)


def plain_neighbours(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.int64(piecewise.xxhash.xxh64(r[1].encode(), seed=42).intdigest() - (1 << 64) * (piecewise.xxhash.xxh64(r[1].encode(), seed=42).intdigest() >> 63))))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text)
        new = text[: n - n // 2] + following[: n // 2]
        own, other, later = (scalar_fingerprint(x.encode()) for x in (text, new, following))
        out.append((i, n, hashlib.sha256(new.encode()).hexdigest(), own, other, scalar_likeness(own, other), scalar_likeness(own, later)))
    return out


def by_text(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1:5]))


def same(got, want):
    got, want = by_text(got), by_text(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=1e-12)


def test_fingerprints_match_plain_version(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = [(i, t) for i, t in rows if len(t or "") < 6000]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, part string, id int").repartition(6)
    got = [tuple(r) for r in piecewise.neighbours(df).collect()]
    same(got, plain_neighbours(rows))
    near, unlike = np.mean([r[5] for r in got]), np.mean([r[6] for r in got])
    assert near > 0.5 and unlike < 0.05


def test_fingerprints_of_odd_texts(spark, monkeypatch):
    rows = [(None, None), (None, "a"), (3, ""), (3, "one two three"), (3, "one two three"), (4, "ab" * 900), (5, "a" * 3000), (6, "é" * 41), (7, "word " * 30), (9, "\n"), (10, "日本語の文章。" * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts in (1, 7):
        same([tuple(r) for r in piecewise.neighbours(df.repartition(parts)).collect()], plain_neighbours(rows))
    same([tuple(r) for r in piecewise.neighbours(df.where("doc_id = 7")).collect()], plain_neighbours(rows[8:9]))
    assert piecewise.neighbours(df.where("false")).count() == 0
    assert {r["fingerprint"] for r in piecewise.fingerprints(df.where("doc_id = 3 and text <> ''")).collect()} == {scalar_fingerprint(b"one two three")}
    both = spark.createDataFrame([("3:abcd:ab", "3:abcd:ab"), ("3:abcdefgh:xy", "6:zzzz:zz"), (None, "3::")], "a string, b string")
    assert [r[0] for r in both.select(piecewise.compared(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]
    # a text is hashed in blocks, and no cut depends on where they end
    text = np.random.default_rng(1).integers(32, 127, 5000, np.uint8).tobytes()
    whole = piecewise.fingerprint(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(piecewise, "BLOCK", size)
        assert piecewise.fingerprint(text) == whole
