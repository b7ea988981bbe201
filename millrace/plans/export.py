"""What a dashboard asks: reports as tables, and the JSON documents made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expr import map_value, with_group
from millrace.model import UNKNOWN_STAGE, Settings
from millrace.operators import conformance, discovery, marts, throughput
from millrace.plans import contracts
from millrace.plans.context import Log
from millrace.plans.together import run_together
from millrace.sources.tables import write_json_document


def executive_kpis(x: Log) -> DataFrame:
    """One row of percentages and means, rounded to one decimal; touchless counts whole cases, coverage is the mean share."""
    pct = lambda c: F.round(F.avg(c.cast("double")) * 100, 1)
    main = x.summary.agg(
        F.count("*").alias("total_cases"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_events"),
        F.round(F.avg("case_duration_days"), 1).alias("avg_case_duration_days"), pct(F.col("has_rework")).alias("rework_rate"),
        pct(F.col("is_happy_path")).alias("happy_path_rate"), pct(F.col("touchless_ratio") == 1.0).alias("touchless_rate"),
        F.round(F.avg("touchless_ratio") * 100, 1).alias("automation_coverage"), pct(F.col("sla_risk") == "high").alias("high_sla_risk_rate"),
        F.round(100.0 * F.sum(F.col("touchless_ratio") * F.col("event_count")) / F.sum("event_count"), 1).alias("batch_event_share"))
    # checks without a verdict (null) count in neither part
    decided = F.size(F.filter("checks", lambda c: c["passed"].isNotNull()))
    passed = F.size(F.filter("checks", lambda c: c["passed"]))
    rate = x.checked.agg(F.round(F.sum(passed) / F.sum(decided) * 100, 1).alias("compliance_rate"))
    return main.crossJoin(F.broadcast(rate))  # one row each


def monthly_trend(x: Log) -> DataFrame:
    """Cases, mean compliance of their cases and mean days by month of start, from the cohort's first year on."""
    rows = x.scored.filter(F.year("case_start") >= x.settings.cohort_year).withColumn("month", F.date_format("case_start", "yyyy-MM"))
    return rows.groupBy("month").agg(
        F.count("*").alias("cases"), F.round(F.coalesce(F.avg("compliance_score"), F.lit(0.0)) * 100, 1).alias("compliance_rate"),
        F.round(F.coalesce(F.avg("case_duration_days"), F.lit(0.0)), 1).alias("avg_duration"))


def sla_distribution(x: Log) -> DataFrame:
    return x.summary.groupBy("sla_risk").agg(F.count("*").alias("case_count"))


def bottleneck_stages(x: Log) -> DataFrame:
    """All transitions of the bottleneck table with the stages of both ends."""
    stage = lambda c: map_value(x.settings.stages, F.col(c), UNKNOWN_STAGE)
    return x.bottlenecks.withColumns({"from_stage": stage("from_activity"), "to_stage": stage("to_activity")})


def case_timelines(x: Log, limit: int | None = None) -> DataFrame:
    """A sample of cases, the first by a hash of their id, each with its ordered events.

    The ids are chosen from the case attributes alone; rows and events of just these (``limit`` of them, hence the broadcasts) follow.
    """
    ids = x.attributes.select("case_id").distinct().orderBy(F.md5(F.col("case_id").cast("binary")), "case_id").limit(limit or x.settings.max_cases)
    chosen = x.summary.join(F.broadcast(ids), "case_id", "left_semi")
    wait = F.round(F.coalesce("time_since_prev_event", F.lit(0.0)) / 3600, 2)
    item = F.struct("event_order", "activity", "ts", "resource", "resource_type", F.col("process_stage").alias("stage"), wait.alias("time_since_prev_hours"))
    events = (x.log.join(F.broadcast(ids), "case_id", "left_semi")
              .groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("events")))
    return chosen.select("case_id", "flow_type", "company", "vendor", "vendor_name", F.round("case_duration_days", 1).alias("duration_days"), "event_count",
                         F.round("compliance_score", 3).alias("compliance_score"), "has_rework", "variant_id", "is_happy_path", "sla_risk"
                         ).join(events, "case_id", "left")


def case_drilldown(x: Log, flow_type: str | None = None, sla_risk: str | None = None, has_rework: bool | None = None,
                   company: str | None = None, limit: int = 100) -> DataFrame:
    """Cases that meet all given conditions, the first by id."""
    rows = x.summary
    for name, value in (("flow_type", flow_type), ("sla_risk", sla_risk), ("has_rework", has_rework), ("company", company)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.select("case_id", "flow_type", "company", "sla_risk", "has_rework", "event_count", "case_duration_days").orderBy("case_id").limit(limit)


def sorted_table(df: DataFrame, column: str, descending: bool = True, limit: int = 100) -> DataFrame:
    """Sort by any column and keep the first rows; ties by all other columns."""
    rest = [c for c in df.columns if c != column]
    return df.orderBy(F.desc(column) if descending else F.asc(column), *rest).limit(limit)


def process_counts(x: Log) -> DataFrame:
    """Bottlenecks and transitions shown: the numbers above the charts."""
    return x.bottlenecks.agg(F.count_if("is_bottleneck").alias("bottlenecks"), F.count("*").alias("edges"), F.sum("transition_count").alias("transitions"))


def rounded(df: DataFrame, places: int, other: dict[str, int]) -> DataFrame:
    """Doubles to ``places``, some to ``other`` places: how a report shows them."""
    return df.withColumns({c: F.round(c, other.get(c, places)) for c, t in df.dtypes if t == "double"})


# Names that the automation document must carry.
AUTOMATION_NAMES = {
    "total_count": "total_executions",
    "human_count": "human_executions",
    "input_uniformity_score": "input_uniformity",
    "timing_regularity_score": "timing_regularity",
    "error_reduction_score": "error_reduction",
    "wait_reduction_score": "wait_reduction",
    "hours_saved_per_month": "estimated_hours_saved_monthly",
}
AUTOMATION_FIELDS = ("activity", "stage", "total_executions", "human_executions", "batch_ratio", "volume_score", "batch_gap_score", "input_uniformity",
                     "timing_regularity", "error_reduction", "wait_reduction", "automation_score", "automation_tier", "estimated_hours_saved_monthly")


def automation_candidates(x: Log) -> DataFrame:
    """A row an activity with its stage, scores to three places and whole hours, the best first."""
    row = x.automation.withColumnsRenamed(AUTOMATION_NAMES).withColumn("stage", map_value(x.settings.stages, F.col("activity"), UNKNOWN_STAGE))
    out = rounded(row, 3, {"estimated_hours_saved_monthly": 0})
    return out.orderBy(F.desc_nulls_first("automation_score"), "activity").select(*AUTOMATION_FIELDS)


def listed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """One row with all rows of ``df`` as a list in the given order: of reports, bounded by their limits or by activities, flows, companies."""
    item = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)], F.struct(*df.columns).alias("_row"))
    return df.agg(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["_row"]).alias(name))


def mapped(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row with a map from ``key`` to the rest of the row."""
    rest = [c for c in df.columns if c != key]
    value = F.struct(*rest) if len(rest) > 1 else F.col(rest[0])
    return df.filter(F.col(key).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value.alias("v"))))).alias(name))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(F.broadcast(r))
    return out


def percent(c: str, places: int = 1) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)) * 100, places)


def hours(c: str) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 2)


def flow_nodes(edges: DataFrame, profile: DataFrame, s: Settings, *keys: str) -> DataFrame:
    """The ends of edges as nodes, for each of ``keys``; the duration is the median to the next event, in the profile's unit."""
    ends = edges.select(*keys, F.col("from_activity").alias("activity")).union(edges.select(*keys, "to_activity")).distinct()
    stage = map_value(s.stages, F.col("activity"), UNKNOWN_STAGE)
    return ends.join(profile.select("activity", "frequency", "median_duration_to_next"), "activity", "left").select(
        *keys, F.col("activity").alias("id"), stage.alias("stage"), discovery.stage_name(stage).alias("stage_name"), F.coalesce("frequency", F.lit(0)).alias("frequency"),
        hours("median_duration_to_next").alias("avg_duration_hours"))


def flow_edges(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.select(*keys, F.col("from_activity").alias("source"), F.col("to_activity").alias("target"), F.col("transition_count").alias("count"),
                        hours("median_wait_hours").alias("median_wait_hours"), "is_bottleneck")


def process_flow(x: Log) -> DataFrame:
    """The graph of frequent edges, whole and by flow."""
    s, most, name = x.settings, -F.col("count"), F.col("id")
    by_flow = discovery.dfg_by_flow(x.log, x.cases, s.min_transitions_by_flow, s).withColumn("is_bottleneck", F.col("p90_wait_hours") > s.bottleneck_hours)

    def lists(df: DataFrame, label: str, *order: Column) -> DataFrame:
        item = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)], F.struct(*[c for c in df.columns if c != "flow_type"]).alias("_row"))
        return df.groupBy("flow_type").agg(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["_row"]).alias(label))

    edges = flow_edges(by_flow, "flow_type")
    flows = lists(flow_nodes(by_flow, x.profile, s, "flow_type"), "nodes", name).join(lists(edges, "edges", most, F.col("source"), F.col("target")), "flow_type")
    return side_by_side(listed(flow_nodes(x.bottlenecks, x.profile, s), "nodes", name),
                        listed(flow_edges(x.bottlenecks), "edges", most, F.col("source"), F.col("target")), mapped(flows, "flow_type", "by_flow_type"))


def overall_rate(x: Log, name: str) -> DataFrame:
    """One row: checks passed of all, in percent."""
    return x.checks.agg(F.round(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)) * 100, 1).alias(name))


def variants_document(x: Log) -> DataFrame:
    top = x.variants.orderBy(F.desc("case_count"), "variant_id").limit(x.settings.max_variants).crossJoin(F.broadcast(overall_rate(x, "compliance_rate")))
    rows = top.select("variant_id", F.col("activity_sequence").alias("sequence"), "case_count", F.round("case_percentage", 2).alias("case_percentage"),
                      F.round(F.coalesce("median_duration_days", F.lit(0.0)), 1).alias("median_duration_days"),
                      F.round(F.coalesce("p90_duration_days", F.lit(0.0)), 1).alias("p90_duration_days"), "compliance_rate", "is_happy_path",
                      F.coalesce("dominant_flow_type", F.lit("")).alias("dominant_flow_type"))
    share = discovery.variant_concentration(x.variants)
    coverage = share.agg(F.struct(*[F.round(F.coalesce(F.max(F.when(F.col("top_n") == k, F.col("concentration_pct"))), F.lit(0.0)), 1).alias(f"top{k}_coverage")
                                    for k in (5, 10, 20)]).alias("concentration"))
    return side_by_side(x.variants.agg(F.count("*").alias("total_variants")), listed(rows, "top_variants", -F.col("case_count"), F.col("variant_id")), coverage)


def compliance_document(x: Log) -> DataFrame:
    rules = conformance.by_rule(x.checks).select("rule_id", "rule_name", "severity", percent("compliance_rate").alias("pass_rate"), F.col("violations").alias("violation_count"))
    rate = percent("compliance_rate").alias("compliance_rate")
    companies = conformance.by_group(x.scored, "company").select("company", rate, "case_count", "critical_violations")
    flows = conformance.by_group(x.scored, "flow_type").select("flow_type", rate, "case_count", F.lit("N/A").alias("top_violation"))
    cells = conformance.by_group(x.scored, "company", "flow_type").select("company", "flow_type", rate, "case_count")
    vendors = conformance.top_violating_vendors(x.scored, x.settings.max_vendors).select(
        "vendor", "vendor_name", F.col("violations").alias("violation_count"), "case_count", F.round("violation_rate", 3).alias("violation_rate"))
    return side_by_side(overall_rate(x, "overall_rate"), listed(rules, "by_rule", F.col("rule_id")), listed(companies, "by_company", F.col("compliance_rate"), F.col("company")),
                        mapped(flows, "flow_type", "by_flow_type"), listed(cells, "heatmap", F.col("company"), F.col("flow_type")),
                        listed(vendors, "top_violating_vendors", -F.col("violation_count"), F.col("vendor"))).withColumn(
        "monthly_trend", F.array().cast("array<struct<month: string, cases: bigint, compliance_rate: double, avg_duration: double>>"))


def bottlenecks_document(x: Log) -> DataFrame:
    rows = bottleneck_stages(x).select("from_activity", "to_activity", "from_stage", "to_stage", F.col("transition_count").alias("count"),
                                       *[hours(c).alias(c) for c in ("median_wait_hours", "p90_wait_hours", "max_wait_hours")], "is_bottleneck", "bottleneck_rank")
    top = throughput.top_bottlenecks(x.bottlenecks, x.settings.max_bottlenecks).select(
        "from_activity", "to_activity", F.col("transition_count").alias("count"), hours("p90_wait_hours").alias("p90_wait_hours"), "impact_score")
    names = (F.col("from_activity"), F.col("to_activity"))
    return side_by_side(listed(rows, "transitions", -F.col("count"), *names), listed(top, "top_bottlenecks", -F.col("p90_wait_hours"), *names))


def case_summaries(x: Log) -> DataFrame:
    event = lambda e: F.struct(e["activity"].alias("activity"), F.date_format(e["ts"], "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), e["resource"].alias("resource"),
                               e["resource_type"].alias("resource_type"), e["stage"].alias("stage"), e["time_since_prev_hours"].alias("time_since_prev_hours"))
    rows = case_timelines(x).withColumn("events", F.transform("events", event))
    return side_by_side(x.attributes.agg(F.count("*").alias("total_cases")), listed(rows, "sample_cases", F.col("case_id")))


# The axes of a company's comparison with its peers.
PEER_DIMENSIONS = ("speed", "compliance", "efficiency", "automation", "volume")


def company_document(x: Log) -> DataFrame:
    more = marts.dim_company(x.cases).select("company", "median_duration_days", "primary_flow_type")
    row = with_group(marts.company_radar(x.summary), more, ["company"])
    values = {"speed": "speed", "compliance": "compliance_rate", "efficiency": "efficiency", "automation": "mean_touchless_ratio", "volume": "volume"}
    radar = F.struct(*[F.round(F.coalesce(values[d], F.lit(0.0)), 3).alias(d) for d in PEER_DIMENSIONS])
    rows = row.select("company", "case_count", F.round("avg_duration_days", 1).alias("avg_duration_days"),
                      F.round(F.coalesce("median_duration_days", F.lit(0.0)), 1).alias("median_duration_days"), percent("compliance_rate").alias("compliance_rate"),
                      percent("rework_rate").alias("rework_rate"), percent("mean_touchless_ratio").alias("touchless_rate"),
                      percent("mean_touchless_ratio").alias("automation_coverage"), F.coalesce("primary_flow_type", F.lit("")).alias("primary_flow_type"), radar.alias("radar"))
    return listed(rows, "companies", -F.col("case_count"), F.col("company")).withColumn("peer_comparison_dimensions", F.array(*map(F.lit, PEER_DIMENSIONS)))


def documents(x: Log) -> dict[str, DataFrame]:
    """One-row tables, each of which is one JSON document of contracts.DOCUMENTS."""
    found = {
        "executive_kpis": side_by_side(executive_kpis(x), listed(monthly_trend(x), "monthly_trend", F.col("month")),
                                       mapped(sla_distribution(x), "sla_risk", "sla_risk_distribution")),
        "process_flow": process_flow(x),
        "variants": variants_document(x),
        "compliance_summary": compliance_document(x),
        "bottlenecks": bottlenecks_document(x),
        "automation_candidates": listed(automation_candidates(x), "activities", F.col("automation_score").isNotNull(), -F.col("automation_score"), F.col("activity")),
        "case_summaries": case_summaries(x),
        "company_benchmarks": company_document(x),
    }
    return {name: contracts.kept(df, name) for name, df in found.items()}


def export_all(x: Log, folder: str) -> int:
    """Write every document under ``folder``; returns how many."""
    found = documents(x)
    run_together(x.spark, {name: lambda df=df, name=name: write_json_document(df, f"{folder}/{name}") for name, df in found.items()})
    return len(found)


def export_sla(scored: DataFrame, metrics: dict, importance: DataFrame, folder: str, limit: int = 100) -> None:
    """The model's document: metrics with the sizes of the split, importances, and the cases with the highest scores."""
    four = lambda c: F.round(c, 4)
    top = scored.orderBy(F.desc("sla_risk_score"), "case_id").limit(limit).select(
        "case_id", "flow_type", F.col("sla_risk").alias("sla_risk_actual"), four("sla_risk_score").alias("sla_risk_score"), "sla_risk_predicted")
    named = {"auc_roc": "auc_roc", "pr_auc": "average_precision", "precision": "precision", "recall": "recall", "f1": "f1"}
    values = [four(F.lit(metrics[v]).cast("double")).alias(k) for k, v in named.items()]
    one = scored.agg(F.struct(*values, F.count_if(~F.col("in_test_set")).alias("n_train"), F.count_if("in_test_set").alias("n_test"),
                              F.round(F.avg((F.col("sla_risk") != "low").cast("double")) * 100, 1).alias("positive_rate")).alias("model_metrics"))
    used = importance.select("feature", F.round(F.col("importance").cast("double"), 1).alias("importance"))
    out = side_by_side(one, listed(used, "feature_importance", -F.col("importance"), F.col("feature")), listed(top, "at_risk_cases", -F.col("sla_risk_score"), F.col("case_id")))
    write_json_document(contracts.kept(out, "sla_risk"), f"{folder}/sla_risk")
