"""Fusion, norm thresholds and arrival counts over unbounded streams, with typed state.

Each has a batch form that gives the same rows for the same input: ``progress.growing``,
``quality_gate.adaptive_threshold`` and ``frames.counts``. A key's rows must come in
order over micro-batches; within one they are put in order. State is what the next
row needs: the retained samples of a track, the last norms of a stream, four numbers
of a stream. With ``idle`` (milliseconds) the state of a key that is silent for so
long expires, and the key begins anew. Spark keeps such state in RocksDB; ``prepared`` sets
that for a session.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vectrail.operators.fusion import MAX_SAMPLES, MIN_SAMPLES
from vectrail.operators.progress import EVERY

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, idle: int | None) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "ProcessingTime" if idle else "None")


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


def fused(samples: list[tuple[float, np.ndarray]], strategy: str, renormalise: bool) -> tuple[np.ndarray | None, float, float]:
    """The fused vector (null where it vanishes), the mean weight and the coherence."""
    w, v = np.array([x[0] for x in samples]), np.stack([x[1] for x in samples])
    if strategy == "median":
        x = np.median(v, axis=0)
    else:
        x = (v * w[:, None]).sum(0) / w.sum() if w.sum() >= 1e-8 else v.mean(0)
    n, total = len(v), v.sum(0)
    coherence = 1.0 if n < 2 else float((total @ total - (v * v).sum()) / (n * (n - 1)))
    length = float(np.linalg.norm(x))
    return None if length < 1e-8 else x / length if renormalise else x, float(w.mean()), coherence


class Fusion(StatefulProcessor):
    """The last ``max_samples`` samples of a track; a row at each point of the schedule."""

    def __init__(self, strategy: str, min_samples: int, every: int, max_samples: int, renormalise: bool, count_all: bool, idle: int | None):
        self.strategy, self.min_samples, self.every, self.max_samples = strategy, min_samples, every, max_samples
        self.renormalise, self.count_all, self.idle = renormalise, count_all, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "seq bigint, weight double, vector array<double>", self.idle)
        self.counts = handle.getValueState("counts", "seen bigint, decided bigint", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = deque(((s, w, np.array(v)) for s, w, v in self.kept.get()), maxlen=self.max_samples)
        seen, decided = self.counts.get() if self.counts.exists() else (0, 0)
        out = []
        for r in _in_order(rows, ["seq"]).itertuples():
            if r.vector is None:
                continue
            held.append((int(r.seq), float(r.weight), np.asarray(r.vector, np.float64)))
            seen += 1
            if self.count_all:
                due = seen >= self.min_samples and (seen - self.min_samples) % self.every == 0
            else:
                due = self.min_samples <= seen <= self.max_samples and (not decided or seen - decided >= self.every)
            if not due:
                continue
            vector, weight, coherence = fused([x[1:] for x in held], self.strategy, self.renormalise)
            if vector is not None:
                decided = seen
                out.append((key[0], seen, len(held), int(r.seq), vector.tolist(), weight, coherence))
        self.kept.put([(s, w, v.tolist()) for s, w, v in held])
        self.counts.update((seen, decided))
        yield pd.DataFrame(out, columns=["track", "seen", "n_samples", "seq", "vector", "mean_weight", "coherence"])

    def close(self) -> None:
        pass


def fuse_stream(samples: DataFrame, strategy: str = "weighted_mean", min_samples: int = MIN_SAMPLES, every: int = EVERY, max_samples: int = MAX_SAMPLES, renormalise: bool = True, count_all: bool = False, idle: int | None = None) -> DataFrame:
    """``progress.growing`` over a stream of samples."""
    if strategy not in ("weighted_mean", "median"):
        raise ValueError(f"no such strategy over a stream: {strategy}")
    kind = dict(samples.dtypes)["track"]
    schema = f"track {kind}, seen bigint, n_samples bigint, seq bigint, vector array<double>, mean_weight double, coherence double"
    return _with_state(samples.select("track", "seq", "weight", "vector"), "track", Fusion(strategy, min_samples, every, max_samples, renormalise, count_all, idle), schema, idle)


class Norms(StatefulProcessor):
    """The ring of a stream's last norms; each row's threshold is read before it joins them."""

    def __init__(self, share: float, ring: int, least: int, floor: float, idle: int | None):
        self.share, self.ring, self.least, self.floor, self.idle = share, ring, least, floor, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.norms = handle.getListState("norms", "norm double", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = deque((x[0] for x in self.norms.get()), maxlen=self.ring)
        table = _in_order(rows, ["seq"])
        out = []
        for seq, norm in zip(table["seq"], table["norm"], strict=True):
            norm = None if pd.isna(norm) else float(norm)
            values = [x for x in held if x is not None]
            limit = max(float(np.quantile(values, self.share)), self.floor) if len(held) >= self.least and values else self.floor
            out.append((key[0], int(seq), norm, limit))
            held.append(norm)
        self.norms.put([(x,) for x in held])
        yield pd.DataFrame(out, columns=["stream_id", "seq", "norm", "threshold"])

    def close(self) -> None:
        pass


def threshold_stream(rows: DataFrame, share: float = 0.35, ring: int = 512, least: int = 64, floor: float = 18.0, idle: int | None = None) -> DataFrame:
    """``quality_gate.adaptive_threshold`` over a stream of calibrated rows: their norms and thresholds."""
    kind = dict(rows.dtypes)["stream_id"]
    source = rows.where("norm_calibrated").select("stream_id", "seq", "norm")
    return _with_state(source, "stream_id", Norms(share, ring, least, floor, idle), f"stream_id {kind}, seq bigint, norm double, threshold double", idle)


class Arrivals(StatefulProcessor):
    """Four numbers of a stream."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "decoded bigint, dropped bigint, back bigint, last bigint", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        decoded, dropped, back, last = self.state.get() if self.state.exists() else (0, 0, 0, None)
        for pts in _in_order(rows, ["packet_index"])["pts"]:
            decoded += 1
            if pd.isna(pts):
                dropped += 1
                continue
            back += last is not None and pts <= last
            last = int(pts)
        self.state.update((decoded, dropped, back, last))
        yield pd.DataFrame([(key[0], decoded, dropped, back)], columns=["stream_id", "n_decoded", "n_dropped", "n_out_of_order"])

    def close(self) -> None:
        pass


def arrival_counts(frames: DataFrame, idle: int | None = None) -> DataFrame:
    """``frames.counts`` (but for the emitted frames) over a stream: after each micro-batch the counts
    so far of every stream in it; a stream's last row stands."""
    kind = dict(frames.dtypes)["stream_id"]
    return _with_state(frames.select("stream_id", "packet_index", "pts"), "stream_id", Arrivals(idle), f"stream_id {kind}, n_decoded bigint, n_dropped bigint, n_out_of_order bigint", idle)
