"""Multi-object tracking: motion filter per axis, three rounds of association.

The kernel class serves streaming (``vectrail.streaming.tracking``); the batch form (``track``)
takes its steps on many parts of streams at once (``vectrail.operators.lanes``). The motion
model couples only a coordinate with its own velocity, so it runs as three two-state filters and one scalar
filter. Streams are independent. In time a stream is cut into chunks of frames that
are tracked at once, each from some frames before it with no tracks at first. Tracks end, so
mostly the same ones live at a chunk's first frame as after the chunk before it, to the last
bit; where digests of the two differ, the chunk is tracked again from the other's tracks,
until none differs. So the result is that of one pass over each stream. Spark deals and sorts
the rows; a task holds the rows of some dozens of chunks and takes them a frame at a time
together. Rows without a frame are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrail.operators.assign import best_pairs
from vectrail.operators.lanes import run_parts
from vectrail.sources.shared import stored

SCHEMA = "stream_id bigint, frame_number bigint, track_id string, state string, x1 double, y1 double, x2 double, y2 double, score double, hits bigint, age bigint, missed bigint, confidence double"


@dataclass(frozen=True)
class Settings:
    high: float = 0.35
    low: float = 0.10
    max_age: int = 30
    min_hits: int = 3
    min_iou: float = 0.30
    delta: int = 3
    inertia: float = 0.20
    second_round: bool = True


class Axis(NamedTuple):
    """Value, velocity and their variances."""

    x: float
    v: float
    a: float
    b: float
    c: float


class Motion:
    """u, v: centre; s: area; r: aspect ratio (no velocity). Measurement noise is 1 for u and v and 10
    for s and r, process noise 1 for all, of the velocities 0.01 (s: 1e-4). The variances do not
    depend on what was measured: u and v have the same, and those of frames that were only
    predicted are made up for at the next update (``due``), as most tracks have none."""

    __slots__ = ("ux", "uv", "vx", "vv", "sx", "sv", "r", "a", "b", "c", "sa", "sb", "sc", "p", "due", "known")

    def __init__(self, box, velocity=(0.0, 0.0)):
        self.ux, self.vx, self.sx, self.r = measure(box)
        self.uv, self.vv = velocity
        self.sv = self.b = self.sb = 0.0
        self.a = self.sa = self.p = 10.0
        self.c = self.sc = 1e4
        self.due, self.known = 0, None

    def predict(self):
        self.ux += self.uv
        self.vx += self.vv
        if self.sx + self.sv <= 0:
            self.sv = 0.0
        self.sx += self.sv
        self.due += 1
        self.known = None

    def settle(self):
        a, b, c, sa, sb, sc, p = self.a, self.b, self.c, self.sa, self.sb, self.sc, self.p
        for _ in range(self.due):
            a += 2 * b + c + 1.0
            b += c
            c += 0.01
            sa += 2 * sb + sc + 1.0
            sb += sc
            sc += 1e-4
            p += 1.0
        self.a, self.b, self.c, self.sa, self.sb, self.sc, self.p, self.due = a, b, c, sa, sb, sc, p, 0

    def update(self, box):
        if self.due:
            self.settle()
        u, v, s, r = measure(box)
        a, b = self.a, self.b
        k, m = a / (a + 1.0), b / (a + 1.0)
        u, v = u - self.ux, v - self.vx
        self.ux += k * u
        self.uv += m * u
        self.vx += k * v
        self.vv += m * v
        self.a, self.b, self.c = (1 - k) * a, (1 - k) * b, self.c - m * b
        a, b = self.sa, self.sb
        k, m, s = a / (a + 10.0), b / (a + 10.0), s - self.sx
        self.sx += k * s
        self.sv += m * s
        self.sa, self.sb, self.sc = (1 - k) * a, (1 - k) * b, self.sc - m * b
        k = self.p / (self.p + 10.0)
        self.r += k * (r - self.r)
        self.p *= 1 - k
        self.known = None

    @property
    def u(self) -> Axis:
        self.settle()
        return Axis(self.ux, self.uv, self.a, self.b, self.c)

    @property
    def v(self) -> Axis:
        self.settle()
        return Axis(self.vx, self.vv, self.a, self.b, self.c)

    @property
    def s(self) -> Axis:
        self.settle()
        return Axis(self.sx, self.sv, self.sa, self.sb, self.sc)

    @property
    def box(self) -> tuple[float, float, float, float]:
        if self.known is None:
            s, r = self.sx, self.r
            if s < 1.0:
                s = 1.0
            w = math.sqrt(s * (r if r > 1e-6 else 1e-6))
            h = s / w / 2
            w /= 2
            self.known = self.ux - w, self.vx - h, self.ux + w, self.vx + h
        return self.known


def measure(box) -> tuple[float, float, float, float]:
    x1, y1, x2, y2 = box
    w, h = x2 - x1, y2 - y1
    return (x1 + x2) / 2, (y1 + y2) / 2, max(w * h, 1.0), max(w / h if h else 0.0, 1e-6)


def overlaps(spots: list[tuple], box) -> dict[int, float]:
    """The overlap (IoU) of a box with those of the spots, which have numbers, where it is positive."""
    bx1, by1, bx2, by2 = box
    own, found = (bx2 - bx1) * (by2 - by1), {}
    for i, (ax1, ay1, ax2, ay2) in spots:
        w = (ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1)
        if w > 0:
            h = (ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1)
            if h > 0:
                inter = w * h
                found[i] = inter / ((ax2 - ax1) * (ay2 - ay1) + own - inter)
    return found


def matched(lines: dict[int, dict[int, float]]) -> list[tuple[int, int]]:
    """The pairs (i, j) of greatest total of ``lines[j][i]``, all positive."""
    best = {}
    for j, line in lines.items():
        if line:
            i = max(line, key=line.get)
            if i in best or len(line) > 1 and list(line.values()).count(line[i]) > 1:
                weight = {(i, j): x for j, line in lines.items() for i, x in line.items()}
                return best_pairs(list(weight), weight)
            best[i] = j
    return list(best.items())  # each has its best, and no two the same


@dataclass
class Track:
    track_id: str
    frame: int  # of the last observation
    motion: Motion
    score: float
    state: str = "tentative"
    hits: int = 1
    age: int = 0
    missed: int = 0
    seen: dict = field(default_factory=dict)  # in the order of frames
    scores: list = field(default_factory=list)
    last_box: tuple = ()

    def heading(self, delta: int) -> tuple[float, float]:
        if len(self.seen) < 2:
            return 0.0, 0.0
        last, then = next(reversed(self.seen)), None
        for f in range(last - delta, last):
            if f in self.seen:
                then = f
                break
        (x, y), (fx, fy) = centre(self.seen[last]), centre(self.seen[next(iter(self.seen)) if then is None else then])
        length = math.hypot(x - fx, y - fy)
        return ((x - fx) / length, (y - fy) / length) if length > 1e-6 else (0.0, 0.0)

    def ahead(self, box, delta: int) -> float:
        """0..1: how well a detection goes on in the track's direction; 0.5 without one."""
        hx, hy = self.heading(delta)
        if not hx and not hy:
            return 0.5
        (x, y), (fx, fy) = centre(box), centre(self.last_box)
        cos = ((x - fx) * hx + (y - fy) * hy) / (math.hypot(x - fx, y - fy) + 1e-6)
        return (min(max(cos, -1.0), 1.0) + 1) / 2

    def observe(self, frame: int, box, score: float, s: Settings, anew: bool = False):
        if anew:  # start again at the new box with the speed since the last one
            last = next(reversed(self.seen))
            (x, y), (fx, fy), n = centre(box), centre(self.seen[last]), max(frame - last, 1)
            self.motion = Motion(box, ((x - fx) / n, (y - fy) / n))
        self.motion.update(box)
        self.hits, self.missed, self.frame, self.score = self.hits + 1, 0, frame, score
        self.remember(frame, box, score, s)
        if self.state == "lost" or self.hits >= s.min_hits:
            self.state = "confirmed"

    def remember(self, frame: int, box, score: float, s: Settings):
        self.seen[frame] = self.last_box = tuple(box)
        oldest = frame - max(4 * s.delta, 16)
        while (f := next(iter(self.seen))) < oldest:
            del self.seen[f]
        self.scores.append(score)
        del self.scores[:-32]

    def miss(self, s: Settings):
        if self.state == "tentative" or self.missed > s.max_age:
            self.state = "removed"
        elif self.state == "confirmed":
            self.state = "lost"

    def confidence(self, s: Settings) -> float:
        c = 0.5 * sum(self.scores) / len(self.scores) + 0.2 * min(self.hits / max(s.min_hits, 1), 1) + 0.3 * max(0.0, 1 - self.missed / max(s.max_age, 1))
        return float(min(max(c, 0.0), 1.0))


def track_name(stream, frame: int, det: int) -> str:
    return hashlib.sha256(f"{stream}|{frame}|{det}".encode()).hexdigest()[:32]


def centre(box) -> tuple[float, float]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


class Tracker:
    """The state of one stream."""

    def __init__(self, stream, settings: Settings = Settings()):
        self.stream, self.s, self.tracks, self.created = stream, settings, [], 0

    def step(self, frame: int, boxes, scores) -> list[Track]:
        """Take one frame's detections; returns the confirmed tracks."""
        s = self.s
        boxes, scores = [tuple(map(float, b)) for b in boxes], [float(x) for x in scores]
        tracks = self.tracks
        for t in tracks:
            t.motion.predict()
            t.age += 1
            t.missed += 1
        free = dict.fromkeys(range(len(tracks)))
        left = dict.fromkeys([k for k, x in enumerate(scores) if x >= s.high])
        low = [k for k, x in enumerate(scores) if s.low <= x < s.high] if s.second_round else []

        def take(pairs, anew=False):
            """Give detections to free tracks; what is left of both stays for the next round."""
            for i, j in pairs:
                tracks[i].observe(frame, boxes[j], scores[j], s, anew)
                del free[i]
                left.pop(j, None)

        spots = [(i, t.motion.box) for i, t in enumerate(tracks)] if left or low else []
        # first round: overlap of the predicted box, and going on in the same direction; gated before solving.
        # A pair outside the gate would count -1, so one inside gains that much more.
        if spots and left:
            take(matched({j: {i: 1 + x + s.inertia * tracks[i].ahead(boxes[j], s.delta) for i, x in overlaps(spots, boxes[j]).items() if x >= s.min_iou} for j in left}))
        # second round: unsure detections can go on a track, but not begin one; gated after solving
        if free and low:
            spots = [x for x in spots if x[0] in free]
            near = {j: overlaps(spots, boxes[j]) for j in low}
            take([(i, j) for i, j in matched(near) if near[j][i] >= s.min_iou])
        # third round: against the last box seen, at half the overlap
        if free and left:
            spots = [(i, tracks[i].last_box) for i in free]
            near = {j: overlaps(spots, boxes[j]) for j in left}
            take([(i, j) for i, j in matched(near) if near[j][i] >= s.min_iou / 2], anew=True)
        for i in free:
            tracks[i].miss(s)
        for d in left:
            t = Track(track_name(self.stream, frame, d), frame, Motion(boxes[d]), scores[d])
            t.remember(frame, boxes[d], scores[d], s)
            tracks.append(t)
            self.created += 1
        self.tracks = [t for t in tracks if t.state != "removed"]
        return [t for t in self.tracks if t.state == "confirmed"]

    def pass_until(self, frame: int):
        """Step through the frames without detections before ``frame``."""
        last = getattr(self, "last_frame", None)
        if last is not None and last + 1 < frame:
            # once every track has expired, a longer gap changes nothing
            for gap in range(last + 1, min(frame, last + self.s.max_age + 2)):
                self.step(gap, (), ())
            self.last_frame = frame - 1

    def advance(self, frame: int, boxes, scores) -> list[tuple]:
        """``step`` with the empty frames since the last one; rows of SCHEMA."""
        self.pass_until(frame)
        self.last_frame = frame
        return [(self.stream, frame, t.track_id, t.state, *t.motion.box, t.score, t.hits, t.age, t.missed, t.confidence(self.s)) for t in self.step(frame, boxes, scores)]


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def run_frames(tracker: Tracker, rows: pd.DataFrame) -> pd.DataFrame:
    """Feed detections, frame by frame in order; frames without any are stepped through as well."""
    out = []
    rows = rows.sort_values(["frame_number", "det"], kind="stable")
    for frame, g in rows.groupby("frame_number", sort=True):
        out += tracker.advance(int(frame), g[["x1", "y1", "x2", "y2"]].to_numpy(float).tolist(), g["score"].tolist())
    return pd.DataFrame(out, columns=NAMES)


CHUNK, WARM = 16_384, 4_096  # frames
LANES, HELD = 80, 8_000_000  # parts at once in a task, and the rows that are enough
BOX = ["x1", "y1", "x2", "y2", "score"]
PASSED = SCHEMA + ", chunk bigint, began binary, ended binary, tracks binary"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.float64()] * 5, *[pa.int64()] * 3, pa.float64(), pa.int64(), *[pa.binary()] * 3]


def whole(c: pa.Array) -> np.ndarray:
    if c.null_count:
        raise ValueError("a box or score is null")
    return c.to_numpy()


def parts_of_rows(batches):
    """(stream, part, frames, boxes, scores, tracks to begin with) of sorted rows, part by part."""
    at, pieces, tracks = None, [], None

    def part():
        return *at, *(np.concatenate([x[k] for x in pieces]) if pieces else np.zeros((0, 4)[: 1 + (k == 1)], np.int64 if k == 0 else float) for k in range(3)), tracks

    for b in batches:
        b = pa.Table.from_batches([b]).combine_chunks()
        stream, number = (b.column(k).to_numpy() for k in (0, 1))
        cuts = np.flatnonzero((np.diff(stream) != 0) | (np.diff(number) != 0)) + 1
        for i, z in itertools.pairwise([0, *cuts.tolist(), len(b)]):
            if i == z:
                continue
            if at != (key := (int(stream[i]), int(number[i]))):
                if at:
                    yield part()
                at, pieces, tracks = key, [], None
            rows = b.slice(i, z - i)
            if rows.column(2).null_count:
                tracks, rows = pickle.loads(rows.column(8)[0].as_py()), rows.slice(1)
            frame, *box, score = (whole(c) for c in rows.columns[2:8])
            pieces.append((frame, np.stack(box, 1), score))
    if at:
        yield part()


def passed(rows: DataFrame, settings: Settings, chunk: int) -> DataFrame:
    """The tracks of every part of a stream, with their chunk: a part begins at the chunk of its
    number and has that or several in a row; what comes before is looked at and gives no rows.
    A row without a frame has the tracks to begin with. For every chunk with frames a row more,
    without a track, tells by digests which tracks lived before it (``began``) and after it
    (``ended``; null: none), and has the latter."""
    keys = ["stream_id", "part", "frame_number"]
    cores, parts = rows.sparkSession.sparkContext.defaultParallelism, rows.select(*keys[:2]).distinct().count()
    # so many that a task's parts fill its lanes, but all cores work; by ranges, as parts are few for a hash to deal evenly
    tasks = cores * max(1, math.ceil(parts / LANES / cores))
    dealt = rows.repartitionByRange(tasks, *keys[:2]).sortWithinPartitions(*keys, "det", *BOX).select(*keys, *BOX, "tracks")
    names = [c.split()[0] for c in PASSED.split(", ")]

    def batch(columns, n):
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=names)

    def digest(tracks):
        return hashlib.sha256(repr(tracks).encode()).digest() if tracks else None

    def tracked(group):
        streams, ids, parts = np.array([g[0] for g in group], np.int64), {}, [g[1:] for g in group]
        group.clear()
        for found in run_parts(parts, settings, chunk):
            if isinstance(found, list):
                for place, at, before, after in found:
                    yield batch([[streams[place]], *[None] * 12, [at], [digest(before)], [digest(after)], [pickle.dumps(after) if after else None]], 1)
                continue
            place, frame, born, det, box, *rest = found
            for key in (x := list(zip(streams[place].tolist(), born.tolist(), det.tolist(), strict=True))):
                if key not in ids:
                    ids[key] = track_name(*key)
            yield batch([streams[place], frame, [ids[k] for k in x], ["confirmed"] * len(x), *box.T, *rest, frame // chunk, None, None, None], len(x))

    def run(batches):
        group, held = [], 0
        for part in parts_of_rows(batches):
            group.append(part)
            held += len(part[2])
            if len(group) >= LANES or held >= HELD:
                del part
                yield from tracked(group)
                held = 0
        if group:
            yield from tracked(group)

    return dealt.mapInArrow(run, PASSED)


def track(detections: DataFrame, settings: Settings = Settings(), chunk: int = CHUNK, warm: int = WARM) -> DataFrame:
    """``detections(stream_id, frame_number, det, x1, y1, x2, y2, score)`` to
    the confirmed tracks of every frame."""
    if not settings.max_age + 2 <= chunk or not 0 <= warm <= chunk:
        raise ValueError(f"a chunk of {chunk} frames is shorter than a track's life unseen or than the {warm} frames before it")
    rows = detections.where("stream_id is not null and frame_number is not null").select(F.col("stream_id").cast("bigint"), F.col("frame_number").cast("bigint"), "det", *BOX)
    within = F.pmod("frame_number", F.lit(chunk))
    rows = stored(rows.withColumn("chunk", F.expr(f"(frame_number - pmod(frame_number, {chunk}L)) div {chunk}L")), "detections")
    parts = F.when(within >= chunk - warm, F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk"))
    none = F.lit(None).cast("binary").alias("tracks")
    found = stored(passed(rows.select("*", F.explode(parts).alias("part"), none), settings, chunk), "tracks")
    ends = found.where("track_id is null").select("stream_id", "chunk", "began", "ended", "tracks")
    key = ["stream_id", "chunk"]
    for done in itertools.count():
        before = ends.select("stream_id", (F.col("chunk") + 1).alias("chunk"), F.col("ended").alias("true"), F.col("tracks").alias("start"))
        wrong = stored(ends.select(*key, "began").join(before, key, "left").where(~F.col("began").eqNullSafe(F.col("true"))).select(*key, "start"), "wrong")
        if wrong.isEmpty():
            return found.where("track_id is not null").select(*NAMES)
        if done >= 3:  # a stream that keeps its tracks: all that is left of it in one go
            first = wrong.groupBy("stream_id").agg(F.min("chunk").alias("first"))
            rest = ends.select(*key).join(first, "stream_id").where("chunk >= first").select(*key)
            wrong = stored(rest.join(wrong, key, "left"), "rest")
        # chunks in a row are one part, which begins with the tracks of the chunk before it
        by_chunk = W.partitionBy("stream_id").orderBy("chunk")
        run = F.col("chunk") - F.row_number().over(by_chunk)
        wrong = wrong.withColumn("run", run).withColumn("part", F.min("chunk").over(W.partitionBy("stream_id", "run")))
        few = F.broadcast(wrong.select(*key, "part"))  # one row a chunk at most
        start = wrong.where("chunk = part and start is not null").select("stream_id", "part", F.col("start").alias("tracks"))
        again = rows.join(few, key).withColumn("tracks", none).unionByName(start, allowMissingColumns=True)
        again = stored(passed(again, settings, chunk), "tracks")
        found = found.join(few, key, "left_anti").unionByName(again)
        ends = stored(found.where("track_id is null").select(*ends.columns), "ends")
