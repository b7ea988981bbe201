"""A stream whose events arrive in any order within the watermark gives the transitions of the batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import discovery, enrich
from millrace.streaming.ordered import ordered_transitions

DDL = "case_id string, activity string, ts timestamp, event_seq long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run(spark, tmp_path, parts, name, late="6 hours", **more):
    for rows in parts:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (ordered_transitions(stream, late, **more).writeStream.format("memory").queryName(name).outputMode("append")
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.set(PROVIDER, before)
    return sorted((r.case_id, r.from_activity, r.to_activity, r.ts, r.wait_seconds) for r in spark.table(name).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch(spark, tmp_path, seed):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = [(f"c{rng.randint(0, 6)}", rng.choice("ABCD"), start + dt.timedelta(minutes=7 * (k // 2)), k) for k in range(120)]  # pairs of equal times
    shuffled = sorted(rows, key=lambda r: r[3] + rng.randint(0, 40))  # up to 40 places, well within six hours
    parts = [shuffled[k:k + 30] for k in range(0, 120, 30)] + [[("end", "Z", start + dt.timedelta(days=30), 999)], [("end", "Z", start + dt.timedelta(days=30), 1000)]]
    batch = discovery.transitions(enrich.enriched(spark.createDataFrame(rows, DDL).withColumns({"resource": F.lit("u"), "event_value": F.lit(1.0)})))
    want = sorted((r.case_id, r.from_activity, r.to_activity, r.to_ts, r.w) for r in batch.select("*", (F.col("wait_hours") * 3600).alias("w")).collect())
    got = run(spark, tmp_path, parts, f"ordered_{seed}")
    assert [r[:4] for r in got] == [r[:4] for r in want] and [r[4] for r in got] == pytest.approx([r[4] for r in want])


def test_beyond_the_watermark_is_dropped(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    parts = [[("a", "A", t(0), 0), ("a", "C", t(5), 1)], [("z", "Z", t(100), 2)], [("a", "late", t(1), 3), ("z", "Y", t(99), 4)], [("z", "Z", t(300), 5)], [("z", "Z", t(301), 6)]]
    assert [r[:3] for r in run(spark, tmp_path, parts, "ordered_late")] == [("a", "A", "C"), ("z", "Y", "Z")]


def test_an_idle_case_starts_anew(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    parts = [[("a", "A", t(0), 0), ("b", "A", t(0), 1)], [("z", "Z", t(3), 2)], [("b", "B", t(4), 3)], [("z", "Z", t(20), 4)], [("a", "B", t(21), 5)], [("z", "Z", t(40), 6)], [("z", "Z", t(41), 7)]]
    got = [r[:3] for r in run(spark, tmp_path, parts, "ordered_idle", idle_days=10) if r[0] != "z"]
    assert got == [("b", "A", "B")]
