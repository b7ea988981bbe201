"""Extension: directly-follows counts of a stream of events, and sessions of users."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last_activity string, last_ts timestamp"
PAIR = "case_id string, from_activity string, to_activity string, ts timestamp, wait_seconds double"


def _pairs(idle_ms: int):
    def pairs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last, when = state.get if state.exists else (None, None)
            rows = pd.concat(list(batches)).sort_values(["ts", "event_seq"])  # one case's events of one micro-batch
            for a, t in zip(rows["activity"], rows["ts"]):
                if when is not None and t < when:
                    continue
                if last is not None:
                    out.append((key[0], last, a, t, (t - when).total_seconds()))
                last, when = a, t
            state.update((last, when))
            state.setTimeoutTimestamp(max(int(pd.Timestamp(when).timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["case_id", "from_activity", "to_activity", "ts", "wait_seconds"])

    return pairs


def stream_transitions(events: DataFrame, late: str = "1 hour", idle_days: float = 365.0) -> DataFrame:
    """Transitions of a stream with columns case_id, activity, ts (timestamp), event_seq; only the last event of a case is kept.

    An event older than the last one seen of its case (late across micro-batches) makes no transition, as negative waits make none
    in a batch; a case without events for ``idle_days`` before the watermark (``late`` behind the latest event) is forgotten.
    """
    return (events.withWatermark("ts", late).groupBy("case_id")
            .applyInPandasWithState(_pairs(int(idle_days * 86_400_000)), PAIR, STATE, "append", GroupStateTimeout.EventTimeTimeout))


def stream_edge_counts(transitions: DataFrame, window: str = "1 day") -> DataFrame:
    """Edge counts by tumbling window."""
    return transitions.groupBy(F.window("ts", window), "from_activity", "to_activity").agg(F.count("*").alias("transition_count"))


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users: events closer than ``gap`` belong together (batch or stream)."""
    return (events.groupBy(F.col(user).alias("user_id"), F.session_window(ts, gap).alias("w"))
            .agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"))
