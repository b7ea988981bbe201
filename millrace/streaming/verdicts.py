"""Rule verdicts of a stream at the event that settles them: the automata of operators.automata as state of the case."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from millrace.model import Settings
from millrace.operators import automata
from millrace.streaming.ordered import OrderedSteps

VERDICT = "case_id string, rule_id string, passed boolean, decided_order long, decided_activity string, t long"


class Verdicts(OrderedSteps):
    """Events in their order through the automata; a row a rule when it is settled."""

    columns = [f.split()[0] for f in VERDICT.split(", ")]

    def __init__(self, rules: automata.Catalogue, idle_ms: int | None):
        super().__init__(idle_ms)
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.folded = handle.getValueState("folded", "kept string")

    def pass_on(self, case_id: str, before: tuple | None, final: list[tuple]) -> list[tuple]:
        case = automata.Case(self.rules, json.loads(self.folded.get()[0]) if before is not None and self.folded.exists() else None)
        out = []
        for event in final:
            if before is not None and not self.goes_on(before, event):
                case = automata.Case(self.rules)
            t, _, activity = before = event
            out += [(case_id, self.rules.names[k], case.outcome(k).passed, case.n, activity, t) for k in case.add(activity, t)]
        self.folded.update((json.dumps(case.kept()),))
        return out

    def forget(self) -> None:
        self.folded.clear()


def verdicts(events: DataFrame, attributes: DataFrame, s: Settings = Settings(), late: str = "1 hour", idle_days: float | None = 365.0) -> DataFrame:
    """case_id, rule_id, rule_name, passed, severity, decided_order, decided_activity, ts: the settled part of automata.ordered_checks.

    events: a stream (case_id, activity, ts, event_seq) in any order within ``late``, as for ordered_transitions, whose rules on late events
    and idle cases hold here too; events without a time are dropped by the watermark.  attributes: a table of cases (case_id, item_category),
    joined to each micro-batch; a case that is not in it has the default flow.  Verdicts that only the end of a case decides are never emitted.
    """
    rules = automata.catalogue(s)
    timed = events.withWatermark("ts", late).select("case_id", "activity", "ts", "event_seq", F.unix_micros("ts").alias("t"))
    idle = None if idle_days is None else int(idle_days * 86_400_000)
    rows = timed.groupBy("case_id").transformWithStateInPandas(Verdicts(rules, idle), VERDICT, "Append", "EventTime")
    flows = automata.with_flow(rows.join(attributes.select("case_id", "item_category"), "case_id", "left"))
    return automata.with_names(flows.filter(automata.in_flow(rules))).select(
        "case_id", "rule_id", "rule_name", "passed", "severity", "decided_order", "decided_activity", F.timestamp_micros("t").alias("ts"))
