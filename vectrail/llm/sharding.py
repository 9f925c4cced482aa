"""Sharding by histogram sort, with DataFrame operations only.

The sort key has 63 bits: 39 bits of the text's hash, then 24 bits of a hash
of the id and the row's number, so equal texts lie together and yet a group of
any size can be cut between its rows, also where they are equal throughout.
The keys are stored before anything is counted, so each row has one key. Splitters are found by counting: the key space is
cut at candidate boundaries, one aggregation gives the exact bytes and rows
in every cell, and only the cells in which a wanted splitter falls are cut
again, until the cell that remains is within tolerance. Then rows move once,
to ``parts`` ranges per shard, where they are numbered; the exact counts
below each range turn those numbers into slots of the whole shard.

The law kept is ``bytes``: shards differ in size by tolerance and one
document. Null texts count as empty; ids may be null or repeated. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.llm.common import stored

OVERHEAD = 16
FIRST_BITS = 12  # the first round counts 2 ** 12 cells
NEXT_BITS = 6
#: Rows that one task numbers, about, and the least and most ranges of a shard.
RANGE_ROWS, LEAST_PARTS, MOST_PARTS = 1_000_000, 16, 256


def sort_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, key)``; keys are unsigned order mapped to 63 bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 25), 24)  # 39 bits above 24
    low = F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 24) - 1))
    return docs.select(F.col(id_col), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), high.bitwiseOR(low).alias("key"))


KEY_BITS = 63


def splitters(keyed: DataFrame, ranges: int, tolerance: float) -> tuple[list[int], list[int], int]:
    """Boundaries b_1 <= ... <= b_(ranges-1) and the rows below each: a row is
    in range r if b_r <= key < b_(r+1). The driver holds one count per probed
    cell: at most 2 ** FIRST_BITS + ranges * 2 ** NEXT_BITS of them a round."""
    bits = FIRST_BITS
    cell = F.shiftright("key", KEY_BITS - bits)
    cells = {r["cell"]: (r["bytes"], r["n"]) for r in keyed.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    total = sum(b for b, _ in cells.values())
    slack = max(1.0, tolerance * total / max(1, ranges))
    found: dict[int, tuple[int, int]] = {}  # splitter -> (boundary, rows below)
    wanted = {k: total * k / ranges for k in range(1, ranges)}
    # cells in order: (start, width in bits, bytes, rows, bytes below, rows below)
    frontier = _walk(sorted(cells.items()), bits, 0, 0)
    pending = {k: (frontier, None) for k in wanted}
    while pending:
        again: dict[int, list[int]] = {}
        for k, (row, _) in list(pending.items()):
            starts, below = row["starts"], row["below"]
            j = max(0, bisect_left(below, wanted[k]) - 1)
            lower, upper = below[j], below[j + 1]
            if bits >= KEY_BITS or min(wanted[k] - lower, upper - wanted[k]) <= slack or row["rows"][j + 1] - row["rows"][j] <= 1:
                near = j if wanted[k] - lower <= upper - wanted[k] else j + 1
                end = (starts[near] if near < len(starts) else starts[-1] + 1) << (KEY_BITS - bits)
                found[k] = (end, row["rows"][near])
                del pending[k]
            else:
                again.setdefault(starts[j], []).append(k)
                pending[k] = (row, (starts[j], lower, row["rows"][j]))
        if not pending:
            break
        step = min(NEXT_BITS, KEY_BITS - bits)
        parents = sorted(again)
        up = F.shiftright("key", KEY_BITS - bits)
        counts = keyed.where(up.isin(parents)).groupBy(F.shiftright("key", KEY_BITS - bits - step).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        bits += step
        inside: dict[int, list] = {}
        for r in counts:
            inside.setdefault(r["cell"] >> step, []).append((r["cell"], (r["bytes"], r["n"])))
        for parent, ks in again.items():
            _, lower, rows = pending[ks[0]][1]
            row = _walk(sorted(inside[parent]), bits, lower, rows)
            for k in ks:
                pending[k] = (row, None)
    order = [found[k] for k in range(1, ranges)]
    for k in range(1, len(order)):  # neighbouring targets may settle on the same boundary
        order[k] = max(order[k], order[k - 1])
    return [b for b, _ in order], [n for _, n in order], total


def _walk(cells: list, bits: int, lower: int, rows: int) -> dict:
    """Running totals over cells in key order: ``below[j]`` and ``rows[j]`` lie before cell j."""
    out = {"starts": [], "below": [lower], "rows": [rows]}
    for start, (size, n) in cells:
        out["starts"].append(start)
        out["below"].append(out["below"][-1] + size)
        out["rows"].append(out["rows"][-1] + n)
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, tolerance: float = 0.02) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)``. Each shard is
    numbered in ``parts`` ranges, by default as many as the rows need."""
    keyed = stored(sort_keys(docs, id_col, text_col), "keys")
    rows = keyed.count()
    parts = parts or min(MOST_PARTS, max(LEAST_PARTS, -(-rows // (shards * RANGE_ROWS))))
    if not rows:
        bounds, below = [], []
    else:
        bounds, below, _ = splitters(keyed, shards * parts, tolerance)
    # the range of a key: how many boundaries lie at or below it, by binary steps over a literal array
    table = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    place = F.lit(0)
    width = 1
    while width < len(bounds) + 1:
        width *= 2
    while width > 1:
        width //= 2
        ahead = place + width
        place = F.when((ahead <= len(bounds)) & (F.get(table, ahead - 1) <= F.col("key")), ahead).otherwise(place)
        # each step is its own projection, else the expression doubles at every step
        keyed = keyed.withColumn("range", place)
        place = F.col("range")
    if "range" not in keyed.columns:
        keyed = keyed.withColumn("range", F.lit(0))
    shard = F.floor(F.col("range") / parts).cast("int")
    starts = [0, *below] + [below[-1] if below else 0] * max(0, shards * parts - 1 - len(below))
    offset = [starts[r] - starts[r - r % parts] for r in range(shards * parts)]
    number = F.row_number().over(W.partitionBy("range").orderBy("key", F.col(id_col), "text_crc32", "size"))
    out = keyed.withColumn("shard", shard).withColumn("slot", (number - 1 + F.get(F.array(*[F.lit(int(x)) for x in offset]), F.col("range"))).cast("bigint"))
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
