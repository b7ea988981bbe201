"""Facts and dimensions of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expr import map_value, value_at, with_places
from millrace.model import UNKNOWN_STAGE, Settings
from millrace.operators import conformance, discovery, enrich, throughput

EVENT_FACT = ["case_id", "activity", "ts", "event_seq", "date", "hour", "day_of_week", "is_weekend", "is_business_hours", "resource",
              "resource_type", "event_value", "event_order", "time_since_prev_event", "process_stage"]


def case_table(attributes: DataFrame, facts: DataFrame) -> DataFrame:
    """Attributes, flow and facts (enrich.case_facts) of every case; cases without events have null facts."""
    return enrich.with_flow(attributes).join(facts, "case_id", "left")


def fact_event_log(log: DataFrame, cases: DataFrame) -> DataFrame:
    """Events with flow, company and vendor of their case."""
    return log.select(*EVENT_FACT).join(cases.select("case_id", "flow_type", "company", "vendor"), "case_id", "left")


SUMMARY_MORE = ["rework_count", "loop_count", "has_rework", "compliance_score", "compliance_flags", "touchless_ratio", "is_happy_path", "handoff_count", "sla_risk"]


def fact_case_summary(checked: DataFrame, attributes: list[str], s: Settings = Settings()) -> DataFrame:
    """Cases with rework, compliance, touchless share, happy path, handoffs and SLA band; what is missing counts as none (compliance 1).

    checked: rows of conformance.case_checks, one a case; only the happy paths (four variants at most, hence the broadcast) are joined.
    """
    happy = discovery.happy_paths(checked).select(F.col("variant_id").alias("_happy"))
    out = conformance.with_scores(checked).join(F.broadcast(happy), F.col("variant_id") == F.col("_happy"), "left")
    out = out.withColumns({"is_happy_path": F.col("_happy").isNotNull(), "sla_risk": throughput.band(s)})
    fills = {"rework_count": 0, "loop_count": 0, "has_rework": False, "compliance_score": 1.0, "touchless_ratio": 0.0, "handoff_count": 0}
    return out.na.fill(fills).select("case_id", *[c for c in attributes if c != "case_id"], "flow_type", *enrich.METRICS, *SUMMARY_MORE)


def dim_activity(profile: DataFrame, s: Settings = Settings()) -> DataFrame:
    stage = map_value(s.stages, F.col("activity"), UNKNOWN_STAGE)
    return profile.withColumns({"stage": stage, "stage_name": discovery.stage_name(stage)})


def _dim(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Cases, days and main flow by ``keys``: counted by flow and days first, then dealt by key once for everything else."""
    counted = cases.groupBy(*keys, "flow_type", "case_duration_days").agg(F.count("*").alias("_n"))
    rows = with_places(counted.repartition(*keys), keys, "case_duration_days").withColumn("_f", F.sum("_n").over(Window.partitionBy(*keys, "flow_type")))
    middle, days = (F.col("_total") - 1) * F.lit(0.5), "case_duration_days"
    return rows.groupBy(*keys).agg(
        F.sum("_n").alias("case_count"), (F.sum(F.col(days) * F.col("_n")) / F.max("_total")).alias("avg_duration_days"),
        F.min(F.struct((-F.col("_f")).alias("n"), "flow_type"))["flow_type"].alias("primary_flow_type"),
        ((value_at(F.floor(middle), days) + value_at(F.ceil(middle), days)) / 2).alias("median_duration_days"))


def dim_company(cases: DataFrame) -> DataFrame:
    return _dim(cases, ["company"])


def dim_vendor(cases: DataFrame) -> DataFrame:
    return _dim(cases, ["vendor", "vendor_name"])


def dim_calendar(log: DataFrame, s: Settings = Settings(), skip_anomalies: bool = False) -> DataFrame:
    """A row a day from the first to the last event; optionally without odd years."""
    src = log.filter(~F.col("is_timestamp_anomaly")) if skip_anomalies else log
    days = src.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a is not null").select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("date"))
    iso = F.weekday("date") + 1
    return days.select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.quarter("date").alias("quarter"),
                       iso.alias("day_of_week"), (iso >= s.weekend_from).alias("is_weekend"), (iso < s.weekend_from).alias("is_business_day"))


def company_radar(summary: DataFrame) -> DataFrame:
    """Company benchmark with five axes, speed and volume against the largest value of all companies."""
    base = summary.groupBy("company").agg(
        F.count("*").alias("case_count"), F.avg("case_duration_days").alias("avg_duration_days"), F.avg(F.col("has_rework").cast("double")).alias("rework_rate"),
        F.avg("touchless_ratio").alias("mean_touchless_ratio"), F.avg(F.col("is_happy_path").cast("double")).alias("happy_path_rate"),
        F.avg("compliance_score").alias("compliance_rate"))
    top = base.agg(F.max("avg_duration_days").alias("_d"), F.max("case_count").alias("_c"))
    share = lambda x, y: F.when(F.col(y) > 0, F.coalesce(F.col(x), F.lit(0.0)) / F.col(y)).otherwise(0.0)
    return base.crossJoin(F.broadcast(top)).withColumns({  # top: one row
        "speed": 1 - share("avg_duration_days", "_d"), "efficiency": 1 - F.coalesce("rework_rate", F.lit(0.0)),
        "volume": share("case_count", "_c")}).drop("_d", "_c")
