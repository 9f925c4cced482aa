"""The tracker over an unbounded stream of detections."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vectrail.operators.tracker import SCHEMA, Settings, Tracker, run_frames


def track_stream(detections: DataFrame, settings: Settings = Settings(), idle: int | None = None) -> DataFrame:
    """As ``vectrail.operators.tracker.track``, keyed by stream, with the
    tracker as state. Frames must come whole and in order over batches; rows of
    frames that were passed already are dropped. The state is the live tracks;
    with ``idle`` (milliseconds) a stream that is silent for so long is
    forgotten, and begins anew when it comes back."""

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(int(key[0]), settings)
        rows = pd.concat(list(batches), ignore_index=True)
        last = getattr(tracker, "last_frame", None)
        if last is not None:
            rows = rows[rows["frame_number"] > last]
        out = run_frames(tracker, rows)
        state.update((pickle.dumps(tracker),))
        if idle:
            state.setTimeoutDuration(idle)
        yield out

    return detections.groupBy("stream_id").applyInPandasWithState(run, SCHEMA, "tracker binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
