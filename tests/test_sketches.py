"""Mergeable profiles: within their bounds, additive by day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import sketches


@pytest.fixture(scope="module")
def log(spark):
    rng, start = random.Random(4), dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=k % 6), f"c{rng.randint(0, 8000)}", rng.choice("ABC"), rng.choice([None, "u1", "u2"]), rng.lognormvariate(3, 2),
             None if k % 5 == 0 else rng.random()) for k in range(30_000)]
    return spark.createDataFrame(rows, "date date, case_id string, activity string, resource string, event_value double, time_since_prev_event double").persist()


def test_estimates_keep_to_their_bounds(spark, log):
    found = sketches.merged(sketches.daily(log))
    assert all(r.distinct_within and r.median_within is not False for r in sketches.within_bounds(log, found).collect())
    rows = {r.column: r for r in found.collect()}
    values = sorted(r.event_value for r in log.select("event_value").collect())
    for q, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
        rank = sum(v <= rows["event_value"][name] for v in values) / len(values)
        assert abs(rank - q) < sketches.RANK_ERROR
    assert (rows["event_value"].low, rows["event_value"].high) == (values[0], values[-1]) and rows["activity"].distinct == 3
    assert rows["time_since_prev_event"].nulls == 6000 and rows["activity"].rows == 30_000 and rows["activity"].p50 is None


def test_a_day_more_touches_that_day_only(spark, log, tmp_path):
    path = str(tmp_path / "days")
    sketches.keep(log.filter("date < '2024-01-06'"), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "days").rglob("*.parquet")}
    sketches.keep(log.filter("date = '2024-01-06'"), path)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "days").rglob("*.parquet")}
    assert before.items() <= after.items() and any("2024-01-06" in str(p) for p in after.keys() - before.keys())
    part = sketches.merged(sketches.kept(spark, path), "2024-01-02", "2024-01-03")
    exact = log.filter("date between '2024-01-02' and '2024-01-03'")
    assert all(r.distinct_within and r.median_within is not False for r in sketches.within_bounds(exact, part).collect())
    whole = {r.column: (r.rows, r.nulls) for r in sketches.merged(sketches.kept(spark, path)).collect()}
    assert whole == {r.column: (r.rows, r.nulls) for r in sketches.merged(sketches.daily(log)).collect()}


def test_empty_and_null_columns(spark, log):
    assert sketches.merged(sketches.daily(log.limit(0))).collect() == []
    none = log.limit(50).withColumns({"event_value": F.lit(None).cast("double"), "resource": F.lit(None).cast("string")})
    rows = {r.column: r for r in sketches.merged(sketches.daily(none)).collect()}
    assert (rows["event_value"].p50, rows["event_value"].nulls, rows["resource"].distinct) == (None, 50, 0)
