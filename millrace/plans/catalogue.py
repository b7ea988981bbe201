"""The registered queries of the engine: (spark, sf_dir) -> DataFrame, doubles rounded to eight places, dates and lists as text.

Eight places: days and hours are multiples of a second, whose exact decimals end before, so no tie is rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DoubleType

from millrace.model import BRONZE_EVENTS
from millrace.operators import automata, automation, conformance, discovery, enrich, graphs, marts, quality, sequences, sketches, sla, throughput
from millrace.plans import export
from millrace.plans.context import Log
from millrace.plans.oracles import RULE_IDS
from millrace.sources import adapter, xes, xes_format
from millrace.sources.tables import scratch, test_table, written
from millrace.streaming.dfg import sessions


def event_log(spark: SparkSession, sf_dir: str) -> Log:
    return Log(adapter.events(spark, sf_dir), adapter.cases(spark, sf_dir), adapter.SETTINGS)


def plain(df: DataFrame) -> DataFrame:
    """Doubles to eight places, dates as text, lists of text joined by ``|``."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, DoubleType):
            c = F.round(c, 8)
        elif isinstance(f.dataType, DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def _to_six(df: DataFrame) -> DataFrame:
    """Waits in microseconds: their exact decimals go on, so they are cut where ties are rare."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def _sequence_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("activities", F.array_join("activity_sequence", "|")).drop("activity_sequence")


def _first_event(x: Log, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the first of each user's events: deduplication by order."""
    raw = test_table(spark, sf_dir, "events")
    return raw.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.min("ts").alias("ts"))


def _conversation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = adapter.conversations(spark, sf_dir).groupBy("case_id").agg(enrich.sequence(F.col("event_seq")).alias("s"))
    from millrace.functions.expr import variant_id
    return (seq.select(variant_id(F.col("s")).alias("variant_id"), F.array_join("s", "|").alias("activities"))
            .groupBy("variant_id").agg(F.count("*").alias("case_count"), F.min("activities").alias("activities")))


def _conversation_dfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("activity").over(Window.partitionBy("case_id").orderBy("event_seq"))
    return (adapter.conversations(spark, sf_dir).select(F.col("activity").alias("from_activity"), after.alias("to_activity"))
            .filter("to_activity is not null").groupBy("from_activity", "to_activity").agg(F.count("*").alias("transition_count")))


def _xes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as XES and read back."""
    path = f"{scratch(spark)}/millrace-xes-{uuid.uuid4().hex}"
    xes.write_xes(adapter.events(spark, sf_dir), path)
    back = xes.bronze_events(xes.read_traces(spark, path))
    return back.select("case_id", "activity", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "resource", "event_value", "event_seq")


def _xes_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as XES and read back by the registered format, in ranges of 64 KiB."""
    path = f"{scratch(spark)}/millrace-xes-{uuid.uuid4().hex}"
    xes.write_xes(adapter.events(spark, sf_dir), path)
    xes_format.register(spark)
    back = spark.read.format("xes").option("rangeBytes", 1 << 16).schema(BRONZE_EVENTS).load(path)
    return back.select("case_id", "activity", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "resource", "event_value", "event_seq")


def _score_metrics(x: Log) -> DataFrame:
    rows = x.summary.select((F.col("sla_risk") != "low").cast("int").alias("target"), F.round(F.col("event_count") / F.lit(6.0), 6).alias("sla_risk_score"))
    return sla.metrics(rows)


def _split(x: Log) -> DataFrame:
    return sla.stratified_split(sla.cohort(x.summary, x.settings))


def _features(x: Log) -> DataFrame:
    chosen = sla.cohort(x.summary, x.settings)
    return sla.features(chosen, sla.stratified_split(chosen))


def _kept_features(x: Log) -> DataFrame:
    return written(_features(x), "sla-features")  # bins, rows of the trees and scores all start from them


def _model_scores(x: Log) -> DataFrame:
    rows = _kept_features(x)
    return sla.score(sla.train(rows).model, rows)


def _model_metrics(x: Log) -> DataFrame:
    """Metrics of the model's own scores of the held-out cases."""
    rows = _kept_features(x)
    return sla.metrics(sla.score(sla.train(rows).model, rows.filter("in_test_set")))


def _timelines(x: Log) -> DataFrame:
    text = F.transform("events", lambda e: F.concat_ws(":", e["event_order"].cast("string"), e["activity"], e["resource"], e["resource_type"], e["stage"],
                                                        F.format_string("%.2f", e["time_since_prev_hours"])))
    return export.case_timelines(x).withColumn("events", text)


def _gates(x: Log) -> DataFrame:
    return quality.bronze_gates(x.events, s=replace(x.settings, expected_activities=5)).unionByName(quality.silver_gates(x.log, x.cases))


def _rule(rule_id: str) -> Callable[[Log], DataFrame]:
    return lambda x: x.checks.filter(F.col("rule_id") == rule_id).select("case_id", "rule_name", "passed", "severity", "detail")


#: Queries over the event log.
OVER_LOG: dict[str, Callable[[Log], DataFrame]] = {
    "resource_class": lambda x: x.events.select("event_seq", "resource", enrich.resource_type(F.col("resource")).alias("resource_type")),
    "flow_type": lambda x: enrich.with_flow(x.attributes).select("case_id", "item_category", "flow_type"),
    "temporal_flags": lambda x: enrich.calendar_flags(x.events, x.settings).select(
        "event_seq", "date", "hour", "day_of_week", "is_timestamp_anomaly", "is_weekend", "is_business_hours"),
    "event_order": lambda x: x.log.select("case_id", "event_seq", "event_order", "time_since_case_start", "time_since_prev_event"),
    "case_metrics": lambda x: _sequence_as_text(enrich.case_metrics(x.log)),
    "resource_profile": lambda x: enrich.dim_resource(x.log),
    "activity_profile": lambda x: x.profile,
    "variant_stats": lambda x: _sequence_as_text(x.variants),
    "variant_ids": lambda x: sequences.variant_ids(x.events),
    "variant_frequencies": lambda x: sequences.variant_frequencies(x.events),
    "case_happy_path": lambda x: discovery.case_happy_path(x.cases, x.variants),
    "transitions": lambda x: x.steps,
    "dfg_edges": lambda x: discovery.dfg_edges(x.steps, x.settings),
    "dfg_nodes": lambda x: discovery.dfg_nodes(discovery.dfg_edges(x.steps, x.settings), x.profile, x.settings),
    "dfg_by_flow": lambda x: _to_six(discovery.dfg_by_flow(x.log, x.cases, x.settings.min_transitions_by_flow, x.settings)),
    "dfg_acyclic": lambda x: graphs.acyclic_edges(discovery.dfg_edges(x.steps, x.settings)),
    "bottlenecks": lambda x: x.bottlenecks,
    "bottlenecks_by_flow": lambda x: throughput.bottlenecks_by_flow(x.flow_steps, x.settings),
    "bottleneck_stages": export.bottleneck_stages,
    "waiting_split": lambda x: throughput.waiting_split(x.log),
    "rework": lambda x: x.repeats,
    "predecessor_entropy": lambda x: automation.predecessor_entropy(x.log),
    "successor_entropy": lambda x: automation.successor_entropy(x.log),
    "position_cv": lambda x: automation.position_cv(x.log),
    "error_rate": lambda x: automation.error_rate(x.log),
    "handoffs": lambda x: throughput.handoffs(x.log),
    "touchless": lambda x: throughput.touchless(x.log),
    "sla_band": lambda x: throughput.sla_band(x.cases, x.settings),
    "automation_base": lambda x: automation.automation_base(x.log).drop("position_cv", "error_rate"),
    "automation_score": lambda x: automation.automation_score(x.log, x.settings),
    "automation_candidates": lambda x: export.automation_candidates(x),
    "tier_histogram": lambda x: automation.tier_histogram(automation.automation_score(x.log, x.settings)),
    **{r.lower().replace("-", ""): _rule(r) for r in RULE_IDS},
    "compliance_checks": lambda x: x.checks,
    "ordered_checks": lambda x: automata.ordered_checks(x.events, x.attributes, x.settings),
    "compliance_scores": lambda x: x.scores,
    "fact_event_log": lambda x: marts.fact_event_log(x.log, x.cases),
    "fact_case_summary": lambda x: _sequence_as_text(x.summary),
    "dim_activity": lambda x: marts.dim_activity(x.profile, x.settings),
    "dim_company": lambda x: marts.dim_company(x.cases),
    "dim_vendor": lambda x: marts.dim_vendor(x.cases),
    "dim_calendar": lambda x: marts.dim_calendar(x.log, x.settings),
    "exec_kpis": export.executive_kpis,
    "monthly_trend": export.monthly_trend,
    "sla_distribution": export.sla_distribution,
    "top_variants": lambda x: discovery.top_variants(discovery.variant_stats(x.kept_cases, x.settings), x.scored, x.settings.max_variants),
    "variant_concentration": lambda x: discovery.variant_concentration(x.variants),
    "compliance_by_rule": lambda x: conformance.by_rule(x.checks),
    "compliance_by_company": lambda x: conformance.by_group(x.scored, "company"),
    "compliance_by_flow": lambda x: conformance.by_group(x.scored, "flow_type"),
    "compliance_heatmap": lambda x: conformance.by_group(x.scored, "company", "flow_type"),
    "top_violating_vendors": lambda x: conformance.top_violating_vendors(x.scored, x.settings.max_vendors),
    "top_bottlenecks": lambda x: throughput.top_bottlenecks(x.bottlenecks, x.settings.max_bottlenecks),
    "chart_cap": lambda x: throughput.chart_cap(throughput.top_bottlenecks(x.bottlenecks, x.settings.max_bottlenecks)),
    "process_counts": export.process_counts,
    "case_timelines": _timelines,
    "company_radar": lambda x: marts.company_radar(x.summary),
    "case_drilldown": lambda x: export.case_drilldown(x, flow_type="2way", sla_risk="low", has_rework=True),
    "sorted_cases": lambda x: export.sorted_table(x.cases.select("case_id", "flow_type", "event_count", "case_duration_days"), "case_duration_days"),
    "stratified_split": _split,
    "sla_features": _features,
    "score_metrics": _score_metrics,
    "sla_first_splits": lambda x: sla.first_splits(_kept_features(x)),
    "sla_model_scores": _model_scores,
    "sla_model_metrics": _model_metrics,
    "sla_importance": lambda x: sla.train(_kept_features(x)).importance,
    "orphan_cases": lambda x: quality.orphans(x.log, x.cases.filter("flow_type <> 'consignment'"), "case_id"),
    "null_rates": lambda x: quality.null_rates(x.log),
    "quality_gates": _gates,
    "log_profile": lambda x: quality.log_profile(x.log),
    "sketch_profile": lambda x: sketches.within_bounds(x.log, sketches.merged(sketches.daily(x.log))),
    "activity_frequency": lambda x: quality.frequencies(x.log, "activity"),
}


def _over_log(f: Callable[[Log], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(f(event_log(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _over_log(f) for n, f in OVER_LOG.items()} | {
    "bronze_dedupe": lambda spark, d: plain(_first_event(None, spark, d)),
    "conversation_variants": lambda spark, d: plain(_conversation_variants(spark, d)),
    "conversation_dfg": lambda spark, d: plain(_conversation_dfg(spark, d)),
    "xes_roundtrip": lambda spark, d: plain(_xes_roundtrip(spark, d)),
    "xes_format": lambda spark, d: plain(_xes_format(spark, d)),
    "user_sessions": lambda spark, d: sessions(test_table(spark, d, "events"), "user_id", "ts", "6 hours"),
}
