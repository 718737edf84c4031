"""Texts whose layers arrive over time: a text is emitted once all expected foundries are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def complete_texts(arrivals: DataFrame, expected: list[str], wait_ms: int | None = 86_400_000) -> DataFrame:
    """(text_id, foundries, complete) of a stream of (text_id, foundry). A text that isn't complete after ``wait_ms``
    without news is emitted as incomplete, and its state is dropped; None waits for ever."""
    wanted = frozenset(expected)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0].split(",")) - {""} if state.exists else set()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"text_id": [key[0]], "foundries": [",".join(sorted(seen))], "complete": [False]})
            return
        if "!" in seen:
            return
        for f in frames:
            seen |= set(f["foundry"].dropna())
        if wanted <= seen:
            state.update(("!",))  # later layers of this text are not emitted again
            yield pd.DataFrame({"text_id": [key[0]], "foundries": [",".join(sorted(seen))], "complete": [True]})
        else:
            state.update((",".join(sorted(seen)),))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)

    return arrivals.groupBy("text_id").applyInPandasWithState(step, "text_id string, foundries string, complete boolean", "seen string", "append", GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
