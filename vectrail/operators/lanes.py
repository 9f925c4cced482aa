"""The tracker's steps on many parts of streams at once: arrays with a lane for each part and
a slot for each live track, a frame of every lane at a time. The results are those of
``vectrail.operators.tracker.Tracker``, to the last bit."""

from __future__ import annotations

import math

import numpy as np

from vectrail.operators.assign import best_pairs

DEAD, TENTATIVE, CONFIRMED, LOST = range(4)
STATES = np.array(["removed", "tentative", "confirmed", "lost"])
NEVER, SCORES = np.iinfo(np.int64).max, 32
FLOATS = ["sx", "sv", "r", "a", "b", "c", "sa", "sb", "sc", "p", "score"]
LONGS = ["frame", "born", "det", "hits", "age", "missed"]


def hypot(x, y) -> np.ndarray:
    return np.array([math.hypot(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)])


def measure(box):
    """Centres, areas and aspect ratios."""
    x1, y1, x2, y2 = box.T
    w, h = x2 - x1, y2 - y1
    return np.stack([(x1 + x2) / 2, (y1 + y2) / 2], 1), np.maximum(w * h, 1.0), np.maximum(np.where(h != 0, w / h, 0.0), 1e-6)


def overlaps(a, b) -> np.ndarray:
    """(lane, slot, detection): the overlap (IoU) where it is positive, else 0."""
    ax1, ay1, ax2, ay2 = (x[:, :, None] for x in a)
    bx1, by1, bx2, by2 = (x[:, None, :] for x in b)
    w, h = np.minimum(ax2, bx2) - np.maximum(ax1, bx1), np.minimum(ay2, by2) - np.maximum(ay1, by1)
    inter = w * h
    return np.where((w > 0) & (h > 0), inter / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter), 0.0)


def mean_scores(scores: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean of each row's last scores in order, with the rounding of ``sum``."""
    total, lost = np.zeros(len(n)), np.zeros(len(n))
    first, kept, at = np.where(n > SCORES, n, 0), np.minimum(n, SCORES), np.arange(len(n))
    for k in range(SCORES):
        x = np.where(k < kept, scores[at, (first + k) % SCORES], 0.0)
        t = total + x
        lost += np.where(np.abs(total) >= np.abs(x), (total - t) + x, (x - t) + total)
        total = t
    return (total + lost) / kept


class Lanes:
    def __init__(self, n: int, settings, slots: int = 16):
        self.s, self.n, self.window = settings, n, max(4 * settings.delta, 16)
        self.x = {k: np.zeros((n, slots)) for k in FLOATS} | {k: np.zeros((n, slots), np.int64) for k in LONGS}
        self.x |= {"state": np.zeros((n, slots), np.int8), "n": np.zeros((n, slots), np.int64), "scores": np.zeros((n, slots, SCORES)), "last": np.zeros((n, slots, 4))}
        self.x |= {"pos": np.zeros((n, slots, 2)), "vel": np.zeros((n, slots, 2)), "seen": np.full((n, slots, self.window + 1), -NEVER), "centre": np.zeros((n, slots, self.window + 1, 2))}

    def grow(self):
        more = {k: v[:, : max(4, v.shape[1] // 4)] for k, v in self.x.items()}
        self.x = {k: np.concatenate([v, np.full_like(more[k], -NEVER) if k == "seen" else np.zeros_like(more[k])], 1) for k, v in self.x.items()}

    def slots_for(self, new: np.ndarray) -> np.ndarray:
        """A free slot for each new one of a lane (``new``: how many)."""
        while ((self.x["state"] == DEAD).sum(1) < new).any():
            self.grow()
        return np.argsort(self.x["state"] != DEAD, 1, kind="stable")

    def tracks(self, lane: int) -> list[tuple]:
        """All that the future of a lane depends on, in the order in which the tracks began."""
        out = []
        for t in np.flatnonzero(self.x["state"][lane]).tolist():
            one = {k: v[lane, t] for k, v in self.x.items()}
            n, seen = int(one["n"]), sorted((int(f), *one["centre"][k].tolist()) for k, f in enumerate(one["seen"]) if f >= one["frame"] - self.window)
            scores = [float(one["scores"][k % SCORES]) for k in range(max(n - SCORES, 0), n)]
            out.append((int(one["born"]), int(one["det"]), int(one["state"]), [int(one[k]) for k in LONGS], [float(one[k]) for k in FLOATS], one["pos"].tolist(), one["vel"].tolist(), one["last"].tolist(), seen, scores))
        return sorted(out)

    def begin_with(self, lane: int, tracks: list[tuple]):
        while self.x["state"].shape[1] < len(tracks):
            self.grow()
        for t, (_, _, state, longs, floats, pos, vel, last, seen, scores) in enumerate(tracks):
            for k, v in [*zip(LONGS, longs, strict=True), *zip(FLOATS, floats, strict=True), ("state", state), ("pos", pos), ("vel", vel), ("last", last), ("n", len(scores))]:
                self.x[k][lane, t] = v
            self.x["scores"][lane, t, : len(scores)] = scores
            self.x["seen"][lane, t] = -NEVER
            for f, *centre in seen:
                self.x["seen"][lane, t, f % (self.window + 1)], self.x["centre"][lane, t, f % (self.window + 1)] = f, centre

    def start(self, at, box, velocity):
        """Motion from a box on."""
        x = self.x
        x["pos"][at], x["sx"][at], x["r"][at] = measure(box)
        x["vel"][at] = velocity
        for k, v in (("sv", 0.0), ("b", 0.0), ("sb", 0.0), ("a", 10.0), ("sa", 10.0), ("p", 10.0), ("c", 1e4), ("sc", 1e4)):
            x[k][at] = v

    def remember(self, at, frame, box, score):
        x, k = self.x, frame % (self.window + 1)
        x["frame"][at], x["score"][at], x["last"][at] = frame, score, box
        x["seen"][(*at, k)], x["centre"][(*at, k)] = frame, (box[:, :2] + box[:, 2:]) / 2
        n = x["n"][at]
        x["scores"][(*at, n % SCORES)] = score
        x["n"][at] = n + 1

    def ahead(self, at, box) -> np.ndarray:
        """How well boxes go on in the tracks' directions; 0.5 without one."""
        x = self.x
        last, seen = x["frame"][at][:, None], x["seen"][at]
        seen = np.where(seen >= last - self.window, seen, NEVER)
        then = np.where((seen >= last - self.s.delta) & (seen < last), seen, NEVER).min(1)
        then = np.where(then == NEVER, seen.min(1), then)
        here = x["centre"][(*at, last[:, 0] % (self.window + 1))]
        way = here - x["centre"][(*at, then % (self.window + 1))]
        length = hypot(*way.T)
        head = np.where(((length > 1e-6) & ((seen != NEVER).sum(1) > 1))[:, None], way / length[:, None], 0.0)
        step = (box[:, :2] + box[:, 2:]) / 2 - here
        cos = (step[:, 0] * head[:, 0] + step[:, 1] * head[:, 1]) / (hypot(*step.T) + 1e-6)
        return np.where((head == 0).all(1), 0.5, (np.minimum(np.maximum(cos, -1.0), 1.0) + 1) / 2)

    def matched(self, weight: np.ndarray):
        """Lanes, slots and detections of the pairs of greatest total weight; 0 is no pair."""
        best = weight.argmax(1)
        top = np.take_along_axis(weight, best[:, None, :], 1)[:, 0]
        lane, det = np.nonzero(top)
        slot = best[lane, det]
        # a detection with two equal bests: the lane is solved by itself
        slots, place = weight.shape[1], np.arange(len(lane))
        shared = np.zeros(len(weight), bool)
        shared[lane[(weight[lane, :, det] == top[lane, det][:, None]).sum(1) > 1]] = True
        # two with the same best: one of them gets its second, if no other has that for its best
        key = lane * slots + slot
        wanted = np.bincount(key, minlength=len(weight) * slots).reshape(len(weight), slots)
        shared |= (wanted > 2).any(1) | ((wanted == 2).sum(1) > 1)
        two = place[(wanted[lane, slot] == 2) & ~shared[lane]]
        if len(two):
            two = two[np.argsort(lane[two], kind="stable")].reshape(-1, 2)
            other = weight[lane[two], :, det[two]]
            np.put_along_axis(other, slot[two][..., None], 0.0, 2)
            second = other.argmax(2)
            gain = np.take_along_axis(other, second[..., None], 2)[..., 0]
            one, two_ = (top[lane[two[:, k]], det[two[:, k]]] + gain[:, 1 - k] for k in (0, 1))
            loser = (one > two_).astype(int)  # in ``two``: the first keeps its best, so the second does not
            n = np.arange(len(two))
            entry, second, gain = two[n, loser], second[n, loser], gain[n, loser]
            bad = (one == two_) | ((other[n, loser] == gain[:, None]).sum(1) > 1) & (gain > 0) | (gain > 0) & (wanted[lane[entry], second] > 0)
            shared[lane[entry[bad]]] = True
            slot[entry[~bad]] = second[~bad]
            gone = np.zeros(len(lane), bool)
            gone[entry[~bad & (gain == 0)]] = True
            lane, slot, det = lane[~gone], slot[~gone], det[~gone]
        if shared.any():
            clear = ~shared[lane]
            pairs = [np.stack([lane, slot, det])[:, clear]]
            for k in np.flatnonzero(shared).tolist():
                t, d = np.nonzero(weight[k])
                order = np.lexsort((self.x["det"][k, t], self.x["born"][k, t]))  # the kernel's, by age
                rank = {s: i for i, s in enumerate(dict.fromkeys(t[order].tolist()))}
                gain = dict(zip(((rank[s], j) for s, j in zip(t[order].tolist(), d[order].tolist(), strict=True)), weight[k, t[order], d[order]].tolist(), strict=True))
                named = list(rank)
                pairs.append(np.array([(k, named[i], j) for i, j in best_pairs(list(gain), gain)], np.int64).T)
            lane, slot, det = np.concatenate(pairs, 1)
        return lane, slot, det

    def step(self, frame: np.ndarray, box: np.ndarray, score: np.ndarray, there: np.ndarray, live: np.ndarray):
        """One frame of the lanes in ``live``; ``there`` tells which of the (lane, detection) exist."""
        s, x = self.s, self.x
        x["pos"] += x["vel"]
        x["sv"][x["sx"] + x["sv"] <= 0] = 0.0
        x["sx"] += x["sv"]
        for a, b, c, q in (("a", "b", "c", 0.01), ("sa", "sb", "sc", 1e-4)):
            x[a] += 2 * x[b] + x[c] + 1.0
            x[b] += x[c]
            x[c] += q
        x["p"] += 1.0
        x["age"] += 1
        x["missed"] += 1
        free = (x["state"] != DEAD) & live[:, None]
        left = there & (score >= s.high)
        low = there & (score >= s.low) & (score < s.high) & s.second_round

        def take(lane, slot, det, anew=False):
            if not len(lane):
                return
            at, b, f = (lane, slot), box[lane, det], frame[lane]
            if anew:
                was, n = x["last"][at], np.maximum(f - x["frame"][at], 1)
                self.start(at, b, ((b[:, :2] + b[:, 2:]) / 2 - (was[:, :2] + was[:, 2:]) / 2) / n[:, None])
            centre, area, ratio = measure(b)
            va, vb = x["a"][at], x["b"][at]
            k, m, off = va / (va + 1.0), vb / (va + 1.0), centre - x["pos"][at]
            x["pos"][at] += k[:, None] * off
            x["vel"][at] += m[:, None] * off
            x["a"][at], x["b"][at], x["c"][at] = (1 - k) * va, (1 - k) * vb, x["c"][at] - m * vb
            va, vb = x["sa"][at], x["sb"][at]
            k, m, off = va / (va + 10.0), vb / (va + 10.0), area - x["sx"][at]
            x["sx"][at] += k * off
            x["sv"][at] += m * off
            x["sa"][at], x["sb"][at], x["sc"][at] = (1 - k) * va, (1 - k) * vb, x["sc"][at] - m * vb
            k = x["p"][at] / (x["p"][at] + 10.0)
            x["r"][at] += k * (ratio - x["r"][at])
            x["p"][at] *= 1 - k
            x["hits"][at] += 1
            x["missed"][at] = 0
            self.remember(at, f, b, score[lane, det])
            x["state"][at] = np.where((x["state"][at] == LOST) | (x["hits"][at] >= s.min_hits), CONFIRMED, x["state"][at])
            free[at] = False
            left[lane, det] = False

        def some(mask):
            """The detections in ``mask`` moved together: their numbers, boxes, and which exist."""
            pick = np.argsort(~mask, 1, kind="stable")[:, : int(mask.sum(1).max())]
            return pick, np.take_along_axis(box, pick[..., None], 1), np.take_along_axis(mask, pick, 1)

        def near(boxes, some):
            return np.where(free[:, :, None] & some[2][:, None, :], overlaps(boxes, some[1].transpose(2, 0, 1)), 0.0)

        def take_some(some, weight, least=None):
            lane, slot, k = self.matched(weight)
            if least is not None:
                lane, slot, k = (y[weight[lane, slot, k] >= least] for y in (lane, slot, k))
            return lane, slot, some[0][lane, k]

        # the three rounds are those of ``Tracker.step``
        boxes = self.boxes() if there.any() else None
        if left.any():
            high = some(left)
            weight = near(boxes, high)
            at = np.nonzero((weight >= s.min_iou) & (weight > 0))
            gain = np.zeros_like(weight)
            gain[at] = 1 + weight[at] + s.inertia * self.ahead(at[:2], high[1][at[0], at[2]])
            take(*take_some(high, gain))
        if low.any():
            unsure = some(low)
            take(*take_some(unsure, near(boxes, unsure), s.min_iou))
        if left.any():
            high = some(left)
            take(*take_some(high, near(x["last"].transpose(2, 0, 1), high), s.min_iou / 2), anew=True)
        dies = free & ((x["state"] == TENTATIVE) | (x["missed"] > s.max_age))
        x["state"][free & (x["state"] == CONFIRMED)] = LOST
        x["state"][dies] = DEAD
        if left.any():
            slots = self.slots_for(left.sum(1))
            x = self.x  # which may have grown
            lane, det = np.nonzero(left)
            at = lane, slots[lane, (left.cumsum(1) - 1)[lane, det]]
            self.start(at, box[lane, det], 0.0)
            for k, v in (("state", TENTATIVE), ("hits", 1), ("age", 0), ("missed", 0), ("n", 0), ("born", frame[lane]), ("det", det), ("seen", -NEVER)):
                x[k][at] = v
            self.remember(at, frame[lane], box[lane, det], score[lane, det])

    def boxes(self) -> tuple:
        x = self.x
        s = np.maximum(x["sx"], 1.0)
        w = np.sqrt(s * np.maximum(x["r"], 1e-6))
        h = s / w / 2
        w, u, v = w / 2, x["pos"][..., 0], x["pos"][..., 1]
        return u - w, v - h, u + w, v + h


def run_parts(parts: list[tuple], settings, chunk: int):
    """For parts (emptied; number, frames, boxes, scores, tracks to begin with or None), rows of whose frames are
    sorted: blocks of columns (part's place, frame, born, det, box, score, hits, age, missed, confidence),
    then the chunks with frames: (part's place, chunk, tracks before, tracks after)."""
    n = len(parts)
    lanes = Lanes(n, settings)
    starts, number = np.cumsum([0] + [len(p[1]) for p in parts]), np.array([p[0] for p in parts], np.int64)
    tracks_of = [p[4] for p in parts]
    frames, boxes, scores = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    parts.clear()  # which holds the rows a second time
    frames = np.append(frames, NEVER)
    boxes, scores = np.concatenate([boxes, np.zeros((1, 4))]), np.append(scores, 0.0)
    # where the rows of a row's frame end
    new = np.flatnonzero(np.append(np.diff(frames) != 0, True)) + 1
    new = np.union1d(new, starts[1:])
    ends_at = new[np.searchsorted(new, np.arange(len(frames)), side="right")] if len(new) else new
    at, end = starts[:-1].copy(), starts[1:]
    edge, chunk_of, owns, now = number * chunk, np.full(n, -NEVER), np.zeros(n, bool), np.zeros(n, np.int64)
    began, chunks, done, out, held = [None] * n, [], np.zeros(n, bool), [], 0
    for k, tracks in enumerate(tracks_of):
        if tracks:
            lanes.begin_with(k, tracks)
            now[k] = edge[k] - 1
    every = np.arange(n)
    with np.errstate(all="ignore"):
        while True:
            due = np.where(at < end, frames[np.minimum(at, len(frames) - 1)], NEVER)
            frame = np.where((lanes.x["state"] != DEAD).any(1), now + 1, due)
            for k in np.flatnonzero((frame >= edge) & ~done).tolist():
                tracks = lanes.tracks(k)
                if owns[k]:
                    chunks.append((k, int(chunk_of[k]), began[k], tracks))
                if at[k] == end[k]:
                    done[k] = True
                    lanes.x["state"][k] = DEAD
                else:
                    chunk_of[k] = frame[k] // chunk
                    edge[k] = (chunk_of[k] + 1) * chunk
                    owns[k], began[k] = due[k] < edge[k], tracks
            if done.all():
                break
            here = (due == frame) & ~done
            count = np.where(here, ends_at[at] - at, 0)
            wide = max(int(count.max()), 1)
            there = np.arange(wide) < count[:, None]
            rows = np.where(there, at[:, None] + np.arange(wide), len(scores) - 1)
            lanes.step(frame, boxes[rows], scores[rows], there, ~done)
            at, now = at + count, frame
            x = lanes.x
            lane, slot = np.nonzero((x["state"] == CONFIRMED) & (here & (chunk_of > -NEVER))[:, None])
            if len(lane):
                box = np.stack(lanes.boxes(), 2)[lane, slot]
                out.append((every[lane], frame[lane], *(x[k][lane, slot] for k in ("born", "det")), box, *(x[k][lane, slot] for k in ("score", "hits", "age", "missed", "scores", "n"))))
                held += len(lane)
                if held >= 30_000:
                    yield finished(out, settings)
                    out, held = [], 0
    if out:
        yield finished(out, settings)
    yield chunks


def finished(out: list[tuple], s) -> tuple:
    *columns, hits, age, missed, scores, n = (np.concatenate(c) for c in zip(*out, strict=True))
    sure = 0.5 * mean_scores(scores, n) + 0.2 * np.minimum(hits / max(s.min_hits, 1), 1) + 0.3 * np.maximum(0.0, 1 - missed / max(s.max_age, 1))
    return *columns, hits, age, missed, np.minimum(np.maximum(sure, 0.0), 1.0)
