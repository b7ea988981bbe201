"""Transitions of a stream in their true order: events wait in state until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "t long, event_seq long, activity string"
STEP = "case_id string, from_activity string, to_activity string, t long, wait long"
COLUMNS = ["case_id", "from_activity", "to_activity", "t", "wait"]


def _ms(t: int) -> int:
    return t // 1000


class OrderedSteps(StatefulProcessor):
    """Of each case: the events that may still be overtaken (a list), and the last one that was passed on.

    A timer stands at the earliest waiting event.  When the watermark passes it, all events before the watermark are final: they
    are sorted, joined to the one before and leave the list.  A case without waiting events gets a timer at its last event
    plus ``idle_ms`` of event time (event-time state has no time to live of its own), and is forgotten then unless it went on; an event
    that comes after such a rest starts the case anew in any case, so results do not depend on when timers fire.
    """

    columns = COLUMNS

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.last = handle.getValueState("last", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, mark = None, timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            # behind the watermark its place may be taken already
            events = [(int(t), int(n), a) for t, n, a in zip(batch["t"], batch["event_seq"], batch["activity"]) if _ms(int(t)) >= mark]
            if events:
                self.waiting.appendList(events)
                first = min([e[0] for e in events] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(max(_ms(first), mark + 1))
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        events = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        final, rest = [e for e in events if _ms(e[0]) < mark], [e for e in events if _ms(e[0]) >= mark]
        before, out = tuple(self.last.get()) if self.last.exists() else None, []
        if final:
            out, before = self.pass_on(key[0], before, final), final[-1]
        if final:
            self.last.update(before)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(_ms(rest[0][0]), mark + 1))
        else:
            if events:
                self.waiting.clear()
            if before is not None and self.idle_ms is not None:
                if _ms(before[0]) + self.idle_ms < mark:
                    self.last.clear()
                    self.forget()
                else:
                    self.handle.registerTimer(max(_ms(before[0]) + self.idle_ms, mark + 1))
        yield pd.DataFrame(out, columns=self.columns)

    def goes_on(self, before: tuple | None, event: tuple) -> bool:
        """Does the event belong to the case that ``before`` was part of?"""
        return before is not None and (self.idle_ms is None or event[0] - before[0] <= 1000 * self.idle_ms)

    def pass_on(self, case_id: str, before: tuple | None, final: list[tuple]) -> list[tuple]:
        """The result rows of events (t, event_seq, activity) that nothing can overtake any more, in their order."""
        pairs = zip([before, *final], final)
        return [(case_id, a[2], b[2], b[0], b[0] - a[0]) for a, b in pairs if self.goes_on(a, b)]

    def forget(self) -> None:
        """Clear what a subclass keeps of an idle case."""


def ordered_transitions(events: DataFrame, late: str = "1 hour", idle_days: float | None = 365.0) -> DataFrame:
    """Transitions of a stream (case_id, activity, ts, event_seq) as a batch would give them, whatever order the events arrive in.

    Events up to ``late`` behind the latest one are put in their place by (ts, event_seq); older ones are dropped by the watermark.  A
    transition is emitted once the watermark has passed its second event; a case that rests for ``idle_days`` starts anew.  Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass), which holds lists and timers; a task holds one case's waiting events.
    """
    timed = events.withWatermark("ts", late).select("case_id", "activity", "ts", "event_seq", F.unix_micros("ts").alias("t"))
    idle = None if idle_days is None else int(idle_days * 86_400_000)
    steps = timed.groupBy("case_id").transformWithStateInPandas(OrderedSteps(idle), STEP, "Append", "EventTime")
    return steps.select("case_id", "from_activity", "to_activity", F.timestamp_micros("t").alias("ts"), (F.col("wait") / F.lit(1e6)).alias("wait_seconds"))
