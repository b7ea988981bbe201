"""Streamed variant ids: those of the gathered sequences, in fixed memory."""

import hashlib
import tracemalloc

import pyarrow as pa
import pytest
from minilog import T0
from pyspark.sql import functions as F

from millrace.operators import enrich, sequences


def test_ids_are_those_of_the_sequences(make_log, spark):
    events = [(f"c{k % 9}", "ABCD"[(k * k + k // 7) % 4], (k * 37) % 50, "u") for k in range(200)] + [("ties", a, 1, "u") for a in "BAB"]
    x = make_log(events, [])
    want = {r.case_id: (r.variant_id, r.event_count, r.activity_sequence[:3]) for r in enrich.case_metrics(x.log).collect()}
    for parts in (1, 7):
        got = sequences.variant_ids(x.events.repartition(parts)).collect()
        assert {r.case_id: (r.variant_id, r.variant_length, r.first_activities) for r in got} == want and len(got) == len(want)


def test_nulls_and_nothing(spark):
    ddl = "case_id string, activity string, ts timestamp_ntz, event_seq long"
    rows = [("a", "A", T0, 0), ("a", None, T0, 1), ("a", "B", T0, 2), ("n", None, T0, 0), (None, "C", T0, 0), (None, "D", None, 1)]
    df = spark.createDataFrame(rows, ddl)
    short = lambda s: hashlib.md5(s.encode()).hexdigest()[:12]
    assert {r.case_id: (r.variant_id, r.variant_length) for r in sequences.variant_ids(df).collect()} == {
        "a": (short("A|B"), 3), "n": (short(""), 1), None: (short("D|C"), 2)}
    assert sequences.variant_ids(df.limit(0)).collect() == []
    joined = df.groupBy("case_id").agg(enrich.sequence(F.struct("ts", "event_seq").alias("_o")).alias("s"))
    from millrace.functions.expr import variant_id
    assert {r.case_id: r.v for r in joined.select("case_id", variant_id(F.col("s")).alias("v")).collect()} == {"a": short("A|B"), "n": short(""), None: short("D|C")}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_batches_change_nothing(size):
    cases = [("a", ["x", "y"] * 7), ("b", ["z"]), ("c", ["x"] * 1500), ("d", ["y", "x"])]
    flat = [(c, a) for c, acts in cases for a in acts]
    batches = [pa.RecordBatch.from_arrays([pa.array([c for c, _ in flat[k:k + size]]), pa.array([a for _, a in flat[k:k + size]])], names=["case_id", "activity"])
               for k in range(0, len(flat), size)]
    got = [r for b in sequences.folded(2)(iter(batches)) for r in b.to_pylist()]
    assert [(r["case_id"], r["variant_id"], r["variant_length"], r["first_activities"]) for r in got] == [
        (c, hashlib.md5("|".join(a).encode()).hexdigest()[:12], len(a), a[:2]) for c, a in cases]


def test_a_case_of_any_length_in_fixed_memory():
    """One case of a million events holds no more than one of fifty thousand."""
    batch = pa.RecordBatch.from_arrays([pa.array(["big"] * 10_000), pa.array(["Create", "Change"] * 5000)], names=["case_id", "activity"])
    peaks = []
    for n in (5, 100):
        tracemalloc.start()
        rows = [r for b in sequences.folded(3)(batch for _ in range(n)) for r in b.to_pylist()]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        digest = hashlib.md5(("Create|Change|" * (5000 * n))[:-1].encode()).hexdigest()[:12]
        assert rows == [{"case_id": "big", "variant_id": digest, "variant_length": 10_000 * n, "first_activities": ["Create", "Change", "Create"]}]
    assert peaks[1] < 1.2 * peaks[0]


def test_variant_frequencies(make_log):
    x = make_log([(f"c{k}", a, h, "u") for k in range(6) for h, a in enumerate("AB" if k % 3 else "ABC")], [])
    got = {r.first_activities: (r.case_count, r.variant_length) for r in sequences.variant_frequencies(x.events).collect()}
    assert got == {"A|B": (4, 2), "A|B|C": (2, 3)}
