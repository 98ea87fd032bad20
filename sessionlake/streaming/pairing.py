"""Calls and results that arrive in either order, paired by their key as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "call_id string, input string, output string"
STATE = "input string, output string"


def paired(events: DataFrame, wait_ms: int = 3_600_000) -> DataFrame:
    """call_id, input, output of a stream (call_id, kind ``call`` or ``result``, payload): a row when both sides are
    there, and one with what there is when a side does not come in time. State is two texts a key."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *held)], columns=["call_id", "input", "output"])
            return
        call, result = state.get if state.exists else (None, None)
        for frame in frames:
            for kind, payload in zip(frame["kind"], frame["payload"]):
                call, result = (payload, result) if kind == "call" else (call, payload)
        if call is not None and result is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], call, result)], columns=["call_id", "input", "output"])
        else:
            state.update((call, result))
            state.setTimeoutDuration(wait_ms)

    return events.groupBy("call_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
