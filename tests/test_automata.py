"""Automata of the rules: the verdicts of the rules over facts of cases, and the event that settles each, by table and by stream."""

import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.model import Settings
from millrace.operators import automata
from millrace.streaming.verdicts import verdicts

CREATE, RECEIPT, SERVICE, INVOICE, CLEAR = "Create Purchase Order Item", "Record Goods Receipt", "Record Service Entry Sheet", "Record Invoice Receipt", "Clear Invoice"
NAMES = [CREATE, RECEIPT, SERVICE, INVOICE, CLEAR, "Vendor creates invoice", "Delete Purchase Order Item", "Change Price"]
CATEGORIES = ["3-way match, invoice after GR", "3-way match, invoice before GR", "Consignment", "2-way match"]
PLAIN = ["case_id", "rule_id", "rule_name", "passed", "severity", "detail"]


def random_log(seed, n=80, nulls=True):
    """Short cases with many ties in time, some events without a time, some cases without events."""
    rng = random.Random(seed)
    events = [(f"c{c}", rng.choice(NAMES), None if nulls and rng.random() < 0.05 else rng.randint(0, 4), "user_1") for c in range(n) for _ in range(rng.randint(0, 8))]
    return events, [(f"c{c}", rng.choice(CATEGORIES), "v", f"d{c}") for c in range(n)]


def decided(events, rule, s=Settings()):
    """The place of the first event after which no continuation changes the verdict, by definition over (activity, hours) in order."""
    r, first = s.roles, lambda names: next((k for k, (a, t) in enumerate(events) if a in names), None)
    timed = [(k, a, t) for k, (a, t) in enumerate(events) if t is not None]
    if rule in ("CR-001", "CR-002"):
        return next((k for k, a, _ in timed if a == r.clear), None)
    if rule == "CR-006":
        clear = next(((k, t) for k, a, t in timed if a == r.clear), None)
        if clear is None:
            return None
        invoice = next(((k, t) for k, a, t in timed if a == r.invoice), None)
        if invoice and invoice[1] <= clear[1]:
            return max(invoice[0], clear[0])
        return next((k for k, _, t in timed if t > clear[1]), None)
    if rule == "CR-009":
        return next((k for k in range(len(events)) if sum(a == events[k][0] for a, _ in events[:k + 1]) > s.max_repeats), None)
    return first({"CR-003": r.invoice_set, "CR-005": (r.create,), "CR-010": r.terminal_set}[rule])


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_rules_and_to_the_definition(make_log, seed):
    events, cases = random_log(seed)
    x = make_log(events, cases)
    got = automata.ordered_checks(x.events, x.attributes).collect()
    want = x.checks.filter(~F.col("rule_id").isin("CR-007", "CR-008")).collect()
    assert sorted(map(repr, [tuple(r[c] for c in PLAIN) for r in got])) == sorted(map(repr, [tuple(r[c] for c in PLAIN) for r in want]))
    by_case = {}
    for k, (c, a, t, _) in enumerate(events):
        by_case.setdefault(c, []).append((-1 if t is None else t, k, a, t))
    for r in got:
        ordered = [(a, t) for _, _, a, t in sorted(by_case.get(r.case_id, []), key=lambda e: e[:2])]
        place = decided(ordered, r.rule_id)
        assert r.decided_order == (None if place is None else place + 1), (ordered, r)
        assert r.decided_activity == (None if place is None else ordered[place][0])
    assert {r.rule_id for r in got} == set(automata.catalogue().names) and {r.passed for r in got} >= {True, False}


def test_a_settled_verdict_never_changes():
    rules, rng = automata.catalogue(), random.Random(3)
    for _ in range(300):
        case, settled, t = automata.Case(rules), {}, 0
        for _ in range(12):
            t += rng.randint(0, 1)
            case.add(rng.choice(NAMES), t)
            for k, passed in settled.items():
                assert case.outcome(k).passed is passed
            settled |= {k: case.outcome(k).passed for k in case.settled}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_batches_change_nothing(size):
    events, _ = random_log(5, 30)
    events.sort(key=lambda e: (e[0], -1 if e[2] is None else e[2]))
    table = pa.table({"case_id": [e[0] for e in events], "activity": [e[1] for e in events], "ts": pa.array([e[2] for e in events], pa.int64()).cast(pa.timestamp("us"))})
    fold = automata.folded(automata.catalogue())
    rows = lambda n: [r for b in fold(iter(table.to_batches(max_chunksize=n))) for r in b.to_pylist()]
    assert rows(size) == rows(7) and list(fold(iter([]))) == []


def test_kept_state_is_the_case_and_small():
    rules, rng = automata.catalogue(), random.Random(4)
    whole, t = automata.Case(rules), 0
    again = automata.Case(rules)
    for _ in range(5000):
        t += rng.randint(0, 1)
        a = rng.choice(NAMES)
        whole.add(a, t)
        again = automata.Case(rules, json.loads(json.dumps(again.kept())))
        again.add(a, t)
    assert again.kept() == whole.kept() and again.checks() == whole.checks()
    assert len(json.dumps(whole.kept())) < 2000


def test_nothing(make_log, spark):
    x = make_log([], [("a", CATEGORIES[0], "v", "d")])
    got = {r.rule_id: (r.passed, r.decided_order) for r in automata.ordered_checks(x.events, x.attributes).collect()}
    assert got == {"CR-001": (False, None), "CR-009": (True, None), "CR-010": (False, None)}
    assert automata.ordered_checks(x.events, x.attributes.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_the_stream_settles_what_the_table_settles(spark, make_log, tmp_path, seed):
    from test_ordered_stream import DDL, PROVIDER
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = [(f"c{rng.randint(0, 9)}", rng.choice(NAMES), start + dt.timedelta(minutes=7 * (k // 3)), k) for k in range(150)]  # threes of equal times
    cases = spark.createDataFrame([(f"c{k}", CATEGORIES[k % 4]) for k in range(10)] + [("end", CATEGORIES[3])], "case_id string, item_category string")
    shuffled = sorted(rows, key=lambda r: r[3] + rng.randint(0, 40))
    far = start + dt.timedelta(days=30)
    parts = [shuffled[k:k + 50] for k in range(0, 150, 50)] + [[("end", "Z", far, 999)], [("end", "Z", far, 1000)]]
    for part in parts:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (verdicts(stream, cases, late="6 hours").writeStream.format("memory").queryName(f"verdicts_{seed}").outputMode("append")
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.set(PROVIDER, before)
    columns = ["case_id", "rule_id", "rule_name", "passed", "severity", "decided_order", "decided_activity"]
    got = sorted(tuple(r[c] for c in columns) for r in spark.table(f"verdicts_{seed}").collect())
    table = automata.ordered_checks(spark.createDataFrame(rows, DDL), cases).filter("decided_order is not null and case_id <> 'end'")
    assert got == sorted(tuple(r[c] for c in columns) for r in table.collect()) and len(got) > 30
