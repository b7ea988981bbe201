"""Rules on the order of events as automata: one pass over a case's events gives each verdict, and the event that settled it.

A rule is an instance of a template (precedence, first event, absence, presence, bounded repeats) with a few states.  All rules of a
catalogue run as one product of their states, whose steps are computed when first met.  The same fold serves a table
(``ordered_checks``) and a stream (streaming.verdicts).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.model import Settings
from millrace.operators.conformance import RULES
from millrace.operators.enrich import ORDER, with_flow

CHECKS = "array<struct<rule_id:string,passed:boolean,detail:string,in_scope:boolean,decided_order:long,decided_activity:string>>"
ARROW_CHECKS = pa.list_(pa.struct([("rule_id", pa.string()), ("passed", pa.bool_()), ("detail", pa.string()), ("in_scope", pa.bool_()),
                                   ("decided_order", pa.int64()), ("decided_activity", pa.string())]))


class Event(NamedTuple):
    """What a template sees of an event: does it lie in its sets, has it a time, is that later than the time before."""

    marks: tuple[bool, ...]
    timed: bool
    later: bool


class Outcome(NamedTuple):
    in_scope: bool
    passed: bool | None
    detail: str | None


class Order(NamedTuple):
    """State of a precedence: which of the two have come, is the first one of this instant, the verdict ('' while open)."""

    before: bool = False
    after: bool = False
    scoped: bool = False
    fresh: bool = False
    verdict: str = ""


@dataclass(frozen=True)
class Precedence:
    """The first of ``before`` lies before the first of ``after`` (strict), or not after it.  Events without a time only count for the scope.

    Strict: the first ``after`` settles it.  Otherwise ``before`` may still come in the same instant, so the first event of a later time does.
    """

    before: tuple[str, ...]
    after: tuple[str, ...]
    strict: bool
    no_before: str
    late: str
    done: str
    no_after: str | None = None  # None: cases without ``after`` are out of scope
    after_first: bool = False
    start = Order()

    @property
    def sets(self) -> tuple[tuple[str, ...], ...]:
        return self.before, self.after

    def step(self, s: Order, e: Event) -> Order:
        b, a = e.marks
        if a:
            s = s._replace(scoped=True)
        if not e.timed:
            return s
        if e.later:
            s = s._replace(fresh=False, verdict="late" if s.after and not s.verdict else s.verdict)
        if b and not s.before:
            s = s._replace(before=True, fresh=True, verdict="done" if s.after and not s.verdict else s.verdict)
        if a and not s.after:
            holds = s.before and not (self.strict and s.fresh)
            s = s._replace(after=True, verdict="done" if holds else "late" if self.strict else "")
        return s

    def decided(self, s: Order) -> bool:
        return s.verdict != ""

    def outcome(self, s: Order, case: Case, k: int) -> Outcome:
        scoped = s.scoped or self.no_after is not None
        missing = [] if s.before else [(False, self.no_before)]
        if self.no_after is not None and not s.after:
            missing.insert(0 if self.after_first else len(missing), (True, self.no_after))
        if missing:
            return Outcome(scoped, *missing[0])
        return Outcome(scoped, s.verdict == "done" if s.after else None, self.done if s.verdict == "done" else self.late)


@dataclass(frozen=True)
class FirstIs:
    """The first event is ``activity``, for cases that have it: settled by its first occurrence."""

    activity: str
    holds: str
    start = ("", False)  # is the first event the one, has it occurred

    @property
    def sets(self) -> tuple[tuple[str, ...], ...]:
        return ((self.activity,),)

    def step(self, s: tuple, e: Event) -> tuple:
        return s[0] or ("yes" if e.marks[0] else "no"), s[1] or e.marks[0]

    def decided(self, s: tuple) -> bool:
        return s[1]

    def outcome(self, s: tuple, case: Case, k: int) -> Outcome:
        if s[0] == "yes":
            return Outcome(True, True, self.holds)
        return Outcome(s[1], None, None) if case.first is None else Outcome(s[1], False, f"First event is '{case.first}'")


@dataclass(frozen=True)
class Occurs:
    """One of ``activities`` occurs (``wanted``), or none does: the first one settles it.  Texts may hold {n} and {first}."""

    activities: tuple[str, ...]
    wanted: bool
    found: str
    none: str
    start = False

    @property
    def sets(self) -> tuple[tuple[str, ...], ...]:
        return (self.activities,)

    def step(self, s: bool, e: Event) -> bool:
        return s or e.marks[0]

    def decided(self, s: bool) -> bool:
        return s

    def outcome(self, s: bool, case: Case, k: int) -> Outcome:
        n, first = case.hits.get(k, (0, ""))
        return Outcome(True, s == self.wanted, self.found.format(n=n, first=first) if s else self.none)


@dataclass(frozen=True)
class Repeats:
    """No activity occurs more than ``most`` times: settled by the first one too many.  A counter an activity, so not part of the product."""

    most: int
    within: str

    def outcome(self, case: Case) -> Outcome:
        worst = max(case.counts.values(), default=1)
        return Outcome(True, worst <= self.most, self.within if worst <= self.most else f"An activity repeats {worst} times")


@dataclass(frozen=True)
class Catalogue:
    """Automata by rule, the rules that apply to one flow only, and the bound on repeats under its rule."""

    rules: dict
    flows: dict
    repeats: tuple[str, Repeats]

    @cached_property
    def letters(self) -> dict[str, int]:
        """Activities that any rule names; all others are letter 0."""
        names = sorted({a for r in self.rules.values() for group in r.sets for a in group})
        return {a: k + 1 for k, a in enumerate(names)}

    @cached_property
    def marks(self) -> list[tuple]:
        """Of each letter: the marks of every rule, and the rules whose occurrences are counted."""
        out = []
        for a in [None, *sorted(self.letters)]:
            marks = tuple(tuple(a in group for group in r.sets) for r in self.rules.values())
            out.append((marks, [k for k, r in enumerate(self.rules.values()) if isinstance(r, Occurs) and marks[k][0]]))
        return out

    @cached_property
    def steps(self) -> dict:
        return {}

    @property
    def start(self) -> tuple:
        return tuple(r.start for r in self.rules.values())

    def step(self, states: tuple, letter: int, timed: bool, later: bool) -> tuple[tuple, list[int]]:
        """The next states of all rules and the rules that this step settles, computed once for each that occurs."""
        key = states, letter, timed, later
        known = self.steps.get(key)
        if known is None:
            rules, marks = list(self.rules.values()), self.marks[letter][0]
            after = tuple(r.step(s, Event(m, timed, later)) for r, s, m in zip(rules, states, marks))
            known = self.steps[key] = after, [k for k, r in enumerate(rules) if r.decided(after[k]) and not r.decided(states[k])]
        return known

    @property
    def names(self) -> list[str]:
        return [*self.rules, self.repeats[0]]


def catalogue(s: Settings = Settings()) -> Catalogue:
    """The rules of conformance.RULES that the order of one case's events decides: all but those on vendors and on durations."""
    r = s.roles
    # The detail texts.
    ok, open_, late = "GR precedes clearance (compliant)", "No invoice clearance yet (compliant)", "Invoice cleared before goods receipt"
    return Catalogue({
        "CR-001": Precedence(r.receipt, (r.clear,), True, "No goods receipt found before invoice clearance", late, ok, open_),
        "CR-002": Precedence(r.receipt, (r.clear,), True, "Invoice cleared without any goods receipt", late, ok, open_, True),
        "CR-003": Occurs(r.invoice_set, False, "Found {n} invoice events (e.g. {first})", "No invoice activities (compliant)"),
        "CR-005": FirstIs(r.create, "Create PO Item is first event (compliant)"),
        "CR-006": Precedence((r.invoice,), (r.clear,), False, "Invoice cleared without any Record Invoice Receipt event",
                             "Invoice cleared before invoice was recorded", "Invoice receipt precedes clearance (compliant)"),
        "CR-010": Occurs(r.terminal_set, True, "Terminal activity '{first}' present", "No terminal activity found (case may be open)"),
    }, {"CR-001": "3way_invoice_after_gr", "CR-002": "3way_invoice_before_gr", "CR-003": "consignment"},
        ("CR-009", Repeats(s.max_repeats, "No excessive rework (compliant)")))


class Case:
    """What is kept of a case while its events go by: states, the last time, counts of its distinct activities.  Its size does not grow with its events."""

    def __init__(self, rules: Catalogue, kept: dict | None = None):
        self.rules, k = rules, kept or {}
        self.n, self.t, self.first = k.get("n", 0), k.get("t"), k.get("first")
        states = k.get("states")
        self.states = rules.start if states is None else tuple(
            Order(*s) if isinstance(r.start, Order) else tuple(s) if isinstance(s, list) else s for r, s in zip(rules.rules.values(), states))
        self.counts = Counter({a: n for a, n in k.get("counts", [])})
        self.hits = {i: (n, a) for i, n, a in k.get("hits", [])}
        self.settled = {i: (n, a) for i, n, a in k.get("settled", [])}

    def kept(self) -> dict:
        """The case as plain lists and numbers, for the state of a stream."""
        return {"n": self.n, "t": self.t, "first": self.first, "states": [list(s) if isinstance(s, tuple) else s for s in self.states],
                "counts": list(self.counts.items()), "hits": [[i, *v] for i, v in self.hits.items()],
                "settled": [[i, *v] for i, v in self.settled.items()]}

    def add(self, activity: str | None, t: int | None) -> list[int]:
        """Take the next event in order; the rules (by place in Catalogue.names) that it settles."""
        self.n += 1
        if self.n == 1:
            self.first = activity
        timed = t is not None
        later = timed and self.t is not None and t > self.t
        if timed:
            self.t = t
        letter = self.rules.letters.get(activity, 0)
        self.states, new = self.rules.step(self.states, letter, timed, later)
        for k in self.rules.marks[letter][1]:
            n, first = self.hits.get(k, (0, activity))
            self.hits[k] = n + 1, first
        self.counts[activity] += 1
        last = len(self.rules.rules)
        if self.counts[activity] > self.rules.repeats[1].most and last not in self.settled:
            new = [*new, last]
        for k in new:
            self.settled[k] = self.n, activity
        return new

    def outcome(self, k: int) -> Outcome:
        rules = list(self.rules.rules.values())
        return rules[k].outcome(self.states[k], self, k) if k < len(rules) else self.rules.repeats[1].outcome(self)

    def checks(self) -> list[tuple]:
        out = []
        for k, name in enumerate(self.rules.names):
            scope, passed, detail = self.outcome(k)
            out.append((name, passed, detail, scope, *self.settled.get(k, (None, None))))
        return out


def folded(rules: Catalogue):
    """Arrow batches of (case_id, activity, ts), cases one after the other and their events in order, to (case_id, checks).

    A case may go on over any number of batches.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, here = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, done = batch.column(0), []
            times, activities = batch.column(2).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist()
            runs = np.flatnonzero(np.diff(ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False))) + 1
            for a, b in zip([0, *runs.tolist()], [*runs.tolist(), batch.num_rows]):
                name = ids[a].as_py()
                if case is None or name != here:
                    if case is not None:
                        done.append((here, case.checks()))
                    case, here = Case(rules), name
                for activity, t in zip(activities[a:b], times[a:b]):
                    case.add(activity, t)
            yield _rows(done)
        if case is not None:
            yield _rows([(here, case.checks())])

    return fold


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.name for f in ARROW_CHECKS.value_type]
    checks = pa.array([[dict(zip(names, c)) for c in checks] for _, checks in rows], ARROW_CHECKS)
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), checks], names=["case_id", "checks"])


def fold_cases(events: DataFrame, rules: Catalogue) -> DataFrame:
    """case_id and ``checks``, one entry a rule, of every case with events: one shuffle and one sort (which spills) by case."""
    ordered = events.select("case_id", "activity", *ORDER).repartition("case_id").sortWithinPartitions("case_id", *ORDER)
    return ordered.select("case_id", "activity", "ts").mapInArrow(folded(rules), f"case_id string, checks {CHECKS}")


def in_flow(rules: Catalogue):
    """Does the rule apply to the case's flow?"""
    apply = F.lit(True)
    for rule, flow in rules.flows.items():
        apply = apply & ((F.col("rule_id") != rule) | F.col("flow_type").eqNullSafe(F.lit(flow)))
    return apply


def ordered_checks(events: DataFrame, attributes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """case_id, rule_id, rule_name, passed, severity, detail as conformance.compliance_checks gives them, decided_order and decided_activity.

    These two are the event (from 1 in its case) after which the verdict cannot change any more; null: only the end of the case decides.
    The detail may still change after it (a count, a receipt that comes too late).  Cases without events get the verdict of an empty case.
    An event without a time counts where order alone matters, and has no part in who came first.  Rules on vendors and durations
    look beyond one case's events and are not here.
    """
    rules = catalogue(s)
    nothing = F.array(*[F.struct(*[F.lit(v).alias(f.name) for v, f in zip(c, ARROW_CHECKS.value_type)]) for c in Case(rules).checks()]).cast(CHECKS)
    cases = with_flow(attributes).select("case_id", "flow_type").join(fold_cases(events, rules), "case_id", "left")
    rows = cases.select("case_id", "flow_type", F.explode(F.coalesce("checks", nothing)).alias("c")).select("case_id", "flow_type", "c.*")
    return with_names(rows.filter(F.col("in_scope") & in_flow(rules))).select(
        "case_id", "rule_id", "rule_name", "passed", "severity", "detail", "decided_order", "decided_activity")


def with_names(rows: DataFrame) -> DataFrame:
    named = {f: F.create_map(*[F.lit(x) for r in RULES.values() for x in (r.rule_id, getattr(r, a))]) for f, a in (("rule_name", "name"), ("severity", "severity"))}
    return rows.withColumns({f: m[F.col("rule_id")] for f, m in named.items()})
