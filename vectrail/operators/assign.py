"""Optimal one-to-one assignment within small groups, and face-to-body costs."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.geometry import Box, clamp, containment

MAX_COST = 0.65


def assignment(cost) -> list[tuple[int, int]]:
    """(row, column) pairs of least total cost; every row or every column is
    used. Shortest augmenting paths over dual prices, on plain lists: the
    matrices of one frame are small."""
    cost = [[float(x) for x in line] for line in cost]
    if not cost or not cost[0]:
        return []
    if len(cost) > len(cost[0]):
        return sorted((r, c) for c, r in assignment(list(zip(*cost, strict=True))))
    rows, cols = len(cost), len(cost[0])
    if rows == 1:
        return [(0, min(range(cols), key=cost[0].__getitem__))]
    price_r, price_c, owner = [0.0] * rows, [0.0] * cols, [-1] * cols
    for row in range(rows):
        reach, via, left = [math.inf] * cols, [-1] * cols, set(range(cols))
        r, c, base = row, -1, 0.0
        while True:
            line, off = cost[r], base - price_r[r]
            nearest, at = math.inf, -1
            for j in left:
                d = off + line[j] - price_c[j]
                if d < reach[j]:
                    reach[j], via[j] = d, c
                if reach[j] < nearest or reach[j] == nearest and j < at:
                    nearest, at = reach[j], j
            c, base = at, nearest
            left.discard(c)
            if owner[c] < 0:
                break
            r = owner[c]
        price_r[row] += base
        for j in range(cols):
            if j not in left:
                if owner[j] >= 0:
                    price_r[owner[j]] += base - reach[j]
                price_c[j] -= base - reach[j]
        while True:
            before = via[c]
            owner[c] = row if before < 0 else owner[before]
            if before < 0:
                break
            c = before
    return sorted((r, c) for c, r in enumerate(owner) if r >= 0)


def parts_of(edges: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The edges of a two-sided graph by connected part."""
    of_row: dict[int, list] = {}
    of_col: dict[int, list] = {}
    for e in edges:
        part, other = of_row.get(e[0]), of_col.get(e[1])
        if part is None:
            part = [] if other is None else other
        elif other is not None and other is not part:
            if len(part) < len(other):
                part, other = other, part
            part += other
            for i, j in other:
                of_row[i] = of_col[j] = part
        part.append(e)
        of_row[e[0]] = of_col[e[1]] = part
    return list({id(part): part for part in of_row.values()}.values())


def each_best(part: list[tuple[int, int]], weight: dict[tuple[int, int], float]) -> list[tuple[int, int]] | None:
    """The best edge of every line of the shorter side, where each has just one and no two
    meet: nothing can be better then. Else nothing."""
    side = 0 if len({i for i, _ in part}) <= len({j for _, j in part}) else 1
    best: dict[int, tuple] = {}
    for e in part:
        w, least = weight[e], best.get(e[side])
        if least is None or w > least[0]:
            best[e[side]] = (w, e)
        elif w == least[0]:
            return None
    found = [e for _, e in best.values()]
    return found if len({e[1 - side] for e in found}) == len(found) else None


def best_pairs(edges: list[tuple[int, int]], weight: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The one-to-one pairs of greatest total weight (all weights are positive).
    Parts of the graph do not compete, so each is solved by itself."""
    if len(edges) < 2 or len({i for i, _ in edges}) == len({j for _, j in edges}) == len(edges):
        return list(edges)
    found = []
    for part in parts_of(edges):
        best = part if len(part) == 1 else each_best(part, weight)
        if best is None:
            rows, cols = sorted({i for i, _ in part}), sorted({j for _, j in part})
            m = [[-weight.get((i, j), 0.0) for j in cols] for i in rows]
            best = [(rows[r], cols[c]) for r, c in assignment(m) if (rows[r], cols[c]) in weight]
        found += best
    return found


def face_cost(body: Box, face: Box, head: float = 0.45, least: float = 0.6, expected: float = 0.035) -> tuple[Column, Column]:
    """(cost, feasible) of a face and a body: containment, horizontal distance
    of centres, and size ratio."""
    inside = containment(body, face)
    (bx, _), (fx, fy) = body.centre, face.centre
    off = clamp(F.abs(fx - bx) / (body.width / 2 + 1e-6))
    ratio = (face.area + 1e-6) / (body.area + 1e-6)
    size = clamp(F.abs(F.log2(ratio / expected)) / 3)
    feasible = (inside >= least) & (fy <= body.y1 + body.height * head)
    return 0.5 * (1 - inside) + 0.3 * off + 0.2 * size, feasible


def by_group(rows: DataFrame, keys: list[str], kernel, extra=lambda t: t, schema=None) -> DataFrame:
    """``kernel(columns, cuts) -> places`` on whole groups. Rows are dealt and
    sorted by key, and groups are cut from the sorted batches, which costs far
    less than a grouped map when groups are many and tiny. ``columns`` are numpy
    arrays (of the columns that are no keys), group k has the rows cuts[k] to
    cuts[k + 1], and the rows at the places stay, unchanged, as ``extra`` shapes
    them. Null keys are equal. Only one batch and one unfinished group are held."""
    names = [c for c in rows.columns if c not in keys]

    def new_group(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            same = pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b)))
            new[1:] |= ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
        return new

    def run(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
            if held is None or not len(held):
                continue
            cuts = np.flatnonzero(new_group(held))
            ends = cuts if b is not None else np.append(cuts, len(held))
            whole = held.slice(0, int(ends[-1]))
            held = held.slice(int(ends[-1]))
            if len(whole):
                columns = {n: whole.column(n).to_numpy() for n in names}
                places = kernel(columns, ends)
                if len(places):
                    yield from extra(whole.take(pa.array(places, pa.int64()))).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema or rows.schema)


def assign_groups(pairs: DataFrame, keys: list[str], left: str, right: str, cost: str, max_cost: float = MAX_COST) -> DataFrame:
    """Optimal assignment in every group of ``pairs``; pairs missing from a
    group, or with null cost, count as infeasible (1 + max_cost). One group is one
    frame, so it stays small however large the table is."""
    types = dict(pairs.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, left, right]) + ", cost double, score double"

    def kernel(columns, cuts):
        c = columns["cost"].astype(float)
        c = np.where(np.isnan(c), 1 + max_cost, c)
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        # a pair whose partners have no other pair in the frame needs no solving
        alone = np.ones(len(c), bool)
        for side in (left, right):
            code = np.unique(columns[side], return_inverse=True)[1]
            at, n = np.unique(group * (code.max() + 1) + code, return_inverse=True, return_counts=True)[1:]
            alone &= n[at] == 1
        kept = np.flatnonzero(alone & (c <= max_cost)).tolist()
        rest = np.flatnonzero(~alone)
        ls, rs, cs = columns[left], columns[right], c.tolist()
        for places in np.split(rest, np.flatnonzero(np.diff(group[rest])) + 1) if len(rest) else ():
            place = {(ls[p], rs[p]): p for p in places.tolist()}
            # least cost is greatest gain over what an infeasible pair costs
            gain = {e: 1 + max_cost - cs[p] for e, p in place.items() if cs[p] < 1 + max_cost}
            kept += [place[e] for e in best_pairs(list(gain), gain) if cs[place[e]] <= max_cost]
        return kept

    def scored(t: pa.Table) -> pa.Table:
        return t.append_column("score", pc.subtract(1.0, t.column("cost")))

    rows = pairs.select(*keys, left, right, F.col(cost).cast("double").alias("cost"))
    return by_group(rows, keys, kernel, extra=scored, schema=schema)


def suppress(boxes: DataFrame, keys: list[str], limit: float = 0.55) -> DataFrame:
    """Greedy non-maximum suppression in every group: by score, a box goes if
    it overlaps one that stays by more than ``limit``."""

    def kernel(columns, cuts):
        x1, y1, x2, y2, score, det = (columns[n].tolist() for n in ("x1", "y1", "x2", "y2", "score", "det"))
        kept: list[int] = []
        for a, z in itertools.pairwise(cuts.tolist()):
            stay: list[int] = []
            for k in sorted(range(a, z), key=lambda k: (-score[k], det[k])) if z - a > 1 else (a,):
                area = (x2[k] - x1[k]) * (y2[k] - y1[k])
                for j in stay:
                    inter = max(min(x2[j], x2[k]) - max(x1[j], x1[k]), 0.0) * max(min(y2[j], y2[k]) - max(y1[j], y1[k]), 0.0)
                    if inter > limit * ((x2[j] - x1[j]) * (y2[j] - y1[j]) + area - inter):
                        break
                else:
                    stay.append(k)
            kept += stay
        return kept

    return by_group(boxes, keys, kernel)
