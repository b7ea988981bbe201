"""XES ingest, the phases end to end, SQL views, streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.plans import export
from millrace.plans.pipeline import Pipeline, main, register_views
from millrace.sources import xes
from millrace.streaming.dfg import sessions, stream_transitions

TRACE = """<trace><string key="concept:name" value="{case}"/><string key="Item Category" value="{category}"/><boolean key="Goods Receipt" value="true"/>
<string key="Vendor" value="{vendor}"/><string key="Purchasing Document" value="{case}"/><string key="Company" value="companyID_0000"/>
<string key="Item Type" value="Standard"/><string key="Document Type" value="Standard PO"/><string key="Name" value="v"/>{events}</trace>"""
EVENT = """<event><string key="concept:name" value="{a}"/><date key="time:timestamp" value="{t}"/>{more}</event>"""


def log_text(cases):
    return '<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="1.0">\n' + "\n".join(cases) + "\n</log>\n"


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    rows = []
    for k in range(40):
        more = '<string key="org:resource" value="batch_01"/><float key="Cumulative net worth (EUR)" value="12.5"/>'
        events = EVENT.format(a="Create Purchase Order Item", t=f"2018-03-{k % 28 + 1:02d}T10:00:00.000+02:00", more=more)
        events += EVENT.format(a="Clear Invoice", t=f"2018-04-{k % 28 + 1:02d}T{k % 24:02d}:30:00.000+00:00", more="")
        rows.append(TRACE.format(case=f"c{k}", category="2-way match" if k % 2 else "Consignment", vendor=f"v{k % 3}", events=events))
    path = tmp_path_factory.mktemp("xes") / "log.xes"
    path.write_text(log_text(rows))
    return str(path)


def test_xes(spark, source):
    traces = xes.read_traces(spark, source)
    events = xes.bronze_events(traces).orderBy("case_id", "event_seq").collect()
    assert len(events) == 80 and events[0].case_id == "c0" and events[0].event_seq == 0
    assert events[0].timestamp.astimezone(dt.timezone.utc).hour == 8 or events[0].timestamp.hour == 8  # +02:00 becomes UTC
    assert events[0].event_value == 12.5 and events[1].resource is None and events[1].event_value is None
    cases = xes.bronze_cases(traces).collect()
    assert len(cases) == 40 and all(c.goods_receipt for c in cases)


def test_the_first_trace_of_an_id_stays(spark, tmp_path):
    """The second trace has the smaller attributes; position decides, not order of values."""
    rows = [TRACE.format(case="c1", category=c, vendor=v, events="") for c, v in (("Consignment", "v9"), ("2-way match", "v1"))]
    (tmp_path / "log.xes").write_text(log_text(rows))
    cases = xes.bronze_cases(xes.read_traces(spark, str(tmp_path / "log.xes"))).collect()
    assert [(c.vendor, c.item_category) for c in cases] == [("v9", "Consignment")]


def test_stage_mapping(spark, tmp_path):
    from millrace.sources.tables import stage_mapping
    (tmp_path / "stages.json").write_text('{"_meta": {"x": 1},\n "mapping": {"A b": "S1", "C": "S9"}}')
    assert stage_mapping(spark, str(tmp_path / "stages.json")) == {"A b": "S1", "C": "S9"}


def test_phases(spark, source, tmp_path):
    p = Pipeline(spark, str(tmp_path / "out"), source, trees=2)
    assert p.run("silver").status == "failed" and "missing input" in p.run("silver").errors[0]
    assert p.run("ingest", dry_run=True).status == "dry-run"
    results = p.run_all()
    assert [r.status for r in results] == ["ok"] * 6, [r.errors for r in results]
    assert results[3].rows_written == 0  # analytics are part of gold
    names = register_views(p)
    assert "fact_case_summary" in names and spark.sql("select count(*) n from fact_case_summary").first().n == 40
    assert spark.sql("select sum(transition_count) n from fact_bottleneck_analysis").first().n is None  # none is frequent enough
    assert (tmp_path / "out" / "export" / "executive_kpis").exists()
    assert "| event_count | 80 |" in p.profile() and (tmp_path / "out" / "reports" / "profile").exists()
    with pytest.raises(ValueError):
        p.run("nothing")


def test_jobs_run_together(spark, tmp_path):
    from millrace.plans.together import counted, run_together
    seen = {}
    def job(name):
        def run():
            seen[name] = (spark.sparkContext.getLocalProperty("spark.jobGroup.id"), spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
            return counted(spark.range(10 * len(name)), lambda d: d.write.parquet(str(tmp_path / name)))
        return run
    assert run_together(spark, {n: job(n) for n in ("a", "bb", "ccc")}) == {"a": 10, "bb": 20, "ccc": 30}
    assert len({g for g, _ in seen.values()}) == 3 and {p for _, p in seen.values()} == {"a", "bb", "ccc"}
    assert counted(spark.range(0), lambda d: d.write.parquet(str(tmp_path / "none"))) == 0 and run_together(spark, {}) == {}

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        run_together(spark, {"good": lambda: 1, "bad": fails})


def test_documents_hold_what_dashboards_read(spark, source, tmp_path):
    """Rows of the gold tables end up in the documents, under the names of the contract."""
    import json
    p = Pipeline(spark, str(tmp_path / "out"), source, trees=1)
    assert all(p.run(phase).status == "ok" for phase in ("ingest", "silver", "gold", "export"))
    read = lambda n: json.loads(spark.read.text(str(tmp_path / "out" / "export" / n)).first().value)
    rows = read("automation_candidates")["activities"]
    assert {r["activity"] for r in rows} == {"Clear Invoice", "Create Purchase Order Item"} and list(rows[0]) == list(export.AUTOMATION_FIELDS)
    assert {r["stage"] for r in rows} == {"S1", "S7"} and {r["total_executions"] for r in rows} == {40}
    kpi = read("executive_kpis")
    assert kpi["total_cases"] == 40 and sum(kpi["sla_risk_distribution"].values()) == 40 and [m["month"] for m in kpi["monthly_trend"]] == ["2018-03"]
    cases = read("case_summaries")
    assert cases["total_cases"] == 40 and [e["activity"] for e in cases["sample_cases"][0]["events"]] == ["Create Purchase Order Item", "Clear Invoice"]
    assert cases["sample_cases"][0]["events"][0]["timestamp"].startswith("2018-03-")
    variants = read("variants")
    assert variants["total_variants"] == 1 and variants["top_variants"][0]["case_count"] == 40 and variants["concentration"]["top5_coverage"] == 100.0
    flow = read("process_flow")  # 40 transitions: none is frequent enough as a whole or by flow
    assert flow == {"nodes": [], "edges": [], "by_flow_type": {}}
    rules = read("compliance_summary")
    assert [r["rule_id"] for r in rules["by_rule"]] == sorted(r["rule_id"] for r in rules["by_rule"]) and set(rules["by_flow_type"]) == {"2way", "consignment"}
    companies = read("company_benchmarks")
    assert companies["companies"][0]["radar"]["volume"] == 1.0 and len(companies["peer_comparison_dimensions"]) == 5


def test_contracts_refuse_what_they_do_not_declare(mini, spark):
    from millrace.plans import contracts
    for name, df in export.documents(mini).items():
        assert df.schema.simpleString() == contracts.schema(name).simpleString(), name
    df = export.documents(mini)["bottlenecks"]
    for bad in (df.drop("transitions"), df.withColumn("x", F.lit(1)), df.withColumn("top_bottlenecks", F.expr("array(struct(1 as other))"))):
        with pytest.raises(ValueError):
            contracts.kept(bad, "bottlenecks")


def test_gold_runs_again_over_its_own_tables(spark, source, tmp_path):
    p = Pipeline(spark, str(tmp_path / "out"), source, trees=1)
    assert all(p.run(phase).status == "ok" for phase in ("ingest", "silver"))
    assert p.run("gold").rows_written == p.run("gold").rows_written  # again over its own tables


def test_command_line(spark, tmp_path):
    assert main(["--phase", "silver", "--output-dir", str(tmp_path / "none")]) == 1


def test_ingest_expects_the_known_log(spark, source, tmp_path, capsys):
    """Another log fails the counts unless they are given or switched off."""
    ingest = ["--phase", "ingest", "--input", source, "--output-dir", str(tmp_path / "out")]
    assert main(ingest) == 1
    said = capsys.readouterr().out
    assert "event_count" in said and "case_count" in said and "enough_activities" in said
    assert main([*ingest, "--expected-events", "80", "--expected-cases", "40", "--expected-activities", "2"]) == 0
    assert main([*ingest, "--expected-events", "0", "--expected-cases", "0", "--expected-activities", "0"]) == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "A", dt.datetime(2024, 1, 1, 0), 0), ("a", "B", dt.datetime(2024, 1, 1, 1), 1), ("b", "A", dt.datetime(2024, 1, 1, 2), 2), ("a", "C", dt.datetime(2024, 1, 1, 3), 3)]
    ddl = "case_id string, activity string, ts timestamp, event_seq long"
    for k in (0, 2):
        spark.createDataFrame(rows[k:k + 2], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (stream_transitions(stream).writeStream.format("memory").queryName("pairs").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = {(r.from_activity, r.to_activity, r.wait_seconds) for r in spark.table("pairs").collect()}
    assert got == {("A", "B", 3600.0), ("B", "C", 7200.0)}


def test_stream_late_and_idle(spark, tmp_path):
    """A late event makes no negative wait, and a case that rested too long starts anew."""
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    parts = [[("a", "A", day(1, 5), 0), ("b", "A", day(1, 5), 1)], [("a", "late", day(1, 4), 2), ("c", "A", day(20), 3)], [("c", "B", day(21), 4)], [("a", "B", day(21, 1), 5)]]
    ddl = "case_id string, activity string, ts timestamp, event_seq long"
    for rows in parts:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (stream_transitions(stream, idle_days=5).writeStream.format("memory").queryName("late_pairs").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = {(r.case_id, r.from_activity, r.to_activity, r.wait_seconds) for r in spark.table("late_pairs").collect()}
    assert got == {("c", "A", "B", 86400.0)}


def test_sessions(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0)), (1, dt.datetime(2024, 1, 1, 0, 20)), (1, dt.datetime(2024, 1, 1, 2))], "u long, ts timestamp_ntz")
    assert sorted(r.events for r in sessions(df, "u", "ts").collect()) == [1, 2]
    assert sessions(df.limit(0), "u", "ts").agg(F.count("*").alias("n")).first().n == 0
