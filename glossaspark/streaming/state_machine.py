"""Task states as a stream: requested moves in, applied or refused moves out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..domains import TASK_MOVES

OUT = "key long, event_id long, before string, after string, applied boolean, late boolean"
STATE = "status string, last_ts timestamp, last_id long, recent array<long>"


def _moves(remember: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Apply a key's new events in order. Of those not later than the last seen, a
        known id is a replay and gives nothing, another one came late."""
        status, last, recent = "pending", None, []
        if state.exists:
            status, ts, number, recent = state.get
            last, recent = (pd.Timestamp(ts), number), list(recent)
        known = set(recent)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts, wanted in rows[["event_id", "ts", "wanted"]].itertuples(index=False):
            if event_id in known:
                continue
            known.add(event_id)
            recent.append(int(event_id))
            if last is not None and (ts, event_id) < last:
                out.append((key[0], event_id, status, status, False, True))
                continue
            applied = wanted in TASK_MOVES[status]
            out.append((key[0], event_id, status, wanted if applied else status, applied, False))
            status, last = (wanted if applied else status), (ts, event_id)
        if last is not None:
            state.update((status, last[0].to_pydatetime(), int(last[1]), recent[-remember:]))
        yield pd.DataFrame(out, columns=["key", "event_id", "before", "after", "applied", "late"])

    return run


def replay(events: DataFrame, key: str = "user_id", remember: int = 1000) -> DataFrame:
    """Streaming state machine over events (key, event_id, ts, wanted).

    An event that comes after a later one of its key can no longer be applied in order:
    it is put out with ``late`` and moves nothing, so none is lost without a trace. One
    that comes again gives nothing, as long as its id is among the last ``remember`` of
    its key; after that it counts as late. The state is a status, the last event and
    those ids for each key, so it grows with keys and not with events.
    """
    return events.groupBy(key).applyInPandasWithState(_moves(remember), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
