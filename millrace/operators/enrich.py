"""Log enrichment: resource and flow classes, calendar flags, order and gaps of events within their case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expr import group_quantiles, map_value, micro_seconds_between, seconds_between, variant_id
from millrace.model import DEFAULT_FLOW, FLOW_TYPES, UNKNOWN_STAGE, Roles, Settings

#: Total order of a case's events.
ORDER = ("ts", "event_seq")


def by_case():
    return Window.partitionBy("case_id")


def in_order():
    return by_case().orderBy(*ORDER)


def resource_type(resource: Column) -> Column:
    """batch, human or unknown by prefix in any case; null, empty and NONE are unknown."""
    low = F.lower(resource)
    return (F.when(low.startswith("batch_"), "batch").when(low.startswith("user_"), "human").otherwise("unknown"))


def flow_type(item_category: Column) -> Column:
    """Flow of an item category; null and unknown ones fall back to invoice after goods receipt."""
    return map_value(FLOW_TYPES, item_category, DEFAULT_FLOW)


def with_flow(cases: DataFrame) -> DataFrame:
    return cases.withColumn("flow_type", flow_type(F.col("item_category")))


def calendar_flags(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """date, hour, ISO weekday, weekend, business hours, time anomaly.

    By default Friday counts as weekend (``weekend_from`` 5), as in the analysis whose numbers are to be met.
    """
    first, last = s.business_hours
    out = events.withColumns({"date": F.to_date("ts"), "hour": F.hour("ts"), "day_of_week": F.weekday("ts") + 1,
                              "is_timestamp_anomaly": F.year("ts") < s.anomaly_before})
    out = out.withColumn("is_weekend", F.col("day_of_week") >= s.weekend_from)
    return out.withColumn("is_business_hours", (F.col("hour") >= first) & (F.col("hour") < last) & ~F.col("is_weekend"))


def enriched(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All event columns that later steps use: one shuffle and one sort by case for every window."""
    out = calendar_flags(events, s).withColumn("resource_type", resource_type(F.col("resource")))
    out = out.withColumn("process_stage", map_value(s.stages, F.col("activity"), UNKNOWN_STAGE))
    w = in_order()
    return out.withColumns({
        "event_order": F.row_number().over(w).cast("long"),
        "prev_ts": F.lag("ts").over(w), "next_ts": F.lead("ts").over(w),
        "prev_activity": F.lag("activity").over(w), "next_activity": F.lead("activity").over(w),
        "prev_resource": F.lag("resource").over(w),
        "case_start": F.min("ts").over(by_case()),
    }).withColumns({
        "time_since_case_start": micro_seconds_between("case_start", "ts"),
        "time_since_prev_event": micro_seconds_between("prev_ts", "ts"),
        "seconds_to_next": seconds_between("ts", "next_ts"),
    }).drop("case_start")


def sequence(order: Column, activity: Column = None) -> Column:
    """Ordered activities of a group: aggregate expression (a case's own events only)."""
    activity = F.col("activity") if activity is None else activity
    return F.transform(F.array_sort(F.collect_list(F.struct(order, activity.alias("_a")))), lambda x: x["_a"])


def _first_time(*names: str) -> Column:
    return F.min(F.when(F.col("activity").isin(*names), F.col("ts")))


def _first_of(names: tuple[str, ...]) -> Column:
    return F.min_by("activity", F.when(F.col("activity").isin(*names), F.struct(*ORDER)))


def _set_size(name: str) -> Column:
    """Distinct values within a case, null counting as one."""
    return F.size(F.collect_set(name)).cast("long") + F.max(F.col(name).isNull().cast("int"))


#: Columns of case_facts: what a case table shows, repeats of activities, and what the rules look at.
METRICS = ["case_start", "case_end", "event_count", "activity_count", "resource_count", "has_batch_activity", "activity_sequence",
           "case_duration_days", "variant_id"]
REPEATS = ["rework_count", "loop_count", "has_rework", "max_repeat"]
RULE_INPUTS = ["receipt_ts", "invoice_ts", "clear_ts", "first_activity", "has_create", "has_clear", "invoice_events", "first_invoice", "terminal_found"]


def case_facts(log: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """All that is known of a case from its events, one row a case: METRICS, REPEATS, touchless_ratio, handoff_count, RULE_INPUTS.

    One aggregation over the log, which is partitioned by case already; what a query does not use is pruned from it.  A
    case's own events are gathered (its sequence of activities), nothing larger.
    """
    a = F.col("activity")
    out = log.groupBy("case_id").agg(
        F.min("ts").alias("case_start"), F.max("ts").alias("case_end"), F.count("*").alias("event_count"),
        _set_size("activity").alias("activity_count"), _set_size("resource").alias("resource_count"),
        F.bool_or(F.col("resource_type") == "batch").alias("has_batch_activity"),
        sequence(F.struct(*ORDER).alias("_o")).alias("activity_sequence"),
        F.avg((F.col("resource_type") == "batch").cast("double")).alias("touchless_ratio"),
        F.count_if(F.col("prev_resource").isNotNull() & (F.col("resource") != F.col("prev_resource"))).alias("handoff_count"),
        _first_time(*roles.receipt).alias("receipt_ts"), _first_time(roles.invoice).alias("invoice_ts"), _first_time(roles.clear).alias("clear_ts"),
        F.min_by("activity", F.struct(*ORDER)).alias("first_activity"),
        F.bool_or(a == roles.create).alias("has_create"), F.bool_or(a == roles.clear).alias("has_clear"),
        F.count_if(a.isin(*roles.invoice_set)).alias("invoice_events"), _first_of(roles.invoice_set).alias("first_invoice"),
        _first_of(roles.terminal_set).alias("terminal_found"))
    seq = F.col("activity_sequence")
    times = F.transform(F.array_distinct(seq), lambda x: F.size(F.filter(seq, lambda y: y.eqNullSafe(x))).cast("long"))
    out = out.withColumns({"case_duration_days": seconds_between("case_start", "case_end") / F.lit(86400.0), "variant_id": variant_id(seq), "_times": times})
    more = F.filter("_times", lambda n: n > 1)
    return out.withColumns({
        "rework_count": F.size(more).cast("long"), "loop_count": F.aggregate(more, F.lit(0).cast("long"), lambda s, n: s + n - 1),
        "has_rework": F.size(more) > 0, "max_repeat": F.array_max("_times")}).select(
        "case_id", *METRICS, *REPEATS, "touchless_ratio", "handoff_count", *RULE_INPUTS)


def case_metrics(log: DataFrame) -> DataFrame:
    """One row a case: start, end, days, counts, batch flag, activity sequence, variant."""
    return case_facts(log).select("case_id", *METRICS)


def resource_profile(log: DataFrame) -> DataFrame:
    """One row a resource: class, first and last event, counts, its activities in order of name."""
    return log.groupBy("resource").agg(
        F.min("resource_type").alias("resource_type"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count("*").alias("event_count"), F.count_distinct("case_id").alias("case_count"),
        F.array_sort(F.collect_set("activity")).alias("activity_set"))


def dim_resource(log: DataFrame, primary: int = 3) -> DataFrame:
    """resource_profile with its first activities as text."""
    return with_primary(resource_profile(log), primary)


def with_primary(profile: DataFrame, primary: int = 3) -> DataFrame:
    return profile.withColumn("primary_activities", F.array_join(F.slice("activity_set", 1, primary), ", "))


def activity_profile(log: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row an activity: frequency, share of cases, batch and human flags (over half), seconds to the next event."""
    total = log.agg(F.count_distinct("case_id").alias("_cases"))
    base = log.groupBy("activity").agg(
        F.count("*").alias("frequency"), F.count_distinct("case_id").alias("_with"),
        F.avg((F.col("resource_type") == "batch").cast("double")).alias("_batch"),
        F.avg((F.col("resource_type") == "human").cast("double")).alias("_human"))
    base = base.crossJoin(F.broadcast(total)).select(  # total: one row
        "activity", "frequency", (F.col("_with") / F.col("_cases")).alias("case_coverage"),
        (F.col("_batch") > 0.5).alias("typically_batch"), (F.col("_human") > 0.5).alias("typically_human"))
    gaps = group_quantiles(log, ["activity"], "seconds_to_next", median_duration_to_next=("linear", 0.5), p90_duration_to_next=("nearest", s.quantile))
    return base.join(gaps, "activity", "left")
