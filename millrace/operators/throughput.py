"""Where time accumulates: bottlenecks, waits in and out of business hours, handoffs, automation share, SLA bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expr import HOUR, group_quantiles
from millrace.functions.ranks import global_rank
from millrace.model import Settings
from millrace.operators.discovery import dfg_edges, edges
from millrace.operators.enrich import case_facts


def bottlenecks(steps: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Frequent edges; those whose P90 wait exceeds the threshold are ranked by it, the others have no rank."""
    graph = dfg_edges(steps, s).filter(F.col("transition_count") >= s.min_transitions)
    return ranked(graph.withColumn("is_bottleneck", F.col("p90_wait_hours") > s.bottleneck_hours))


def ranked(graph: DataFrame) -> DataFrame:
    """Edges with the global rank of their P90 wait, the longest first; those over the threshold come first, so theirs is 1, 2, 3..."""
    out = global_rank(graph, [F.desc("p90_wait_hours"), F.asc("from_activity"), F.asc("to_activity")], "_rank")
    return out.withColumn("bottleneck_rank", F.when(F.col("is_bottleneck"), F.col("_rank").cast("int"))).drop("_rank")


def bottlenecks_by_flow(steps: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Frequent edges of every flow."""
    if "flow_type" not in steps.columns:
        raise ValueError("transitions need a flow_type column")
    return edges(steps, ["flow_type", "from_activity", "to_activity"], s).filter(F.col("transition_count") >= s.min_transitions_by_flow)


def waiting_split(log: DataFrame) -> DataFrame:
    """Hours waited by case, all and those that follow an event in business hours; cases of one event have no row."""
    step = log.filter(F.col("next_ts").isNotNull()).withColumn("_w", F.col("seconds_to_next") / F.lit(HOUR)).filter("_w >= 0")
    return step.groupBy("case_id").agg(
        F.coalesce(F.sum("_w"), F.lit(0.0)).alias("total_wait_hours"),
        F.coalesce(F.sum(F.when(F.col("is_business_hours"), F.col("_w"))), F.lit(0.0)).alias("business_wait_hours"))


def handoffs(log: DataFrame) -> DataFrame:
    """Changes of resource within a case; nothing changes from a missing resource or at the first event."""
    return case_facts(log).select("case_id", "handoff_count")


def touchless(log: DataFrame) -> DataFrame:
    """Share of batch events by case."""
    return case_facts(log).select("case_id", "touchless_ratio")


def band(s: Settings = Settings()) -> Column:
    """high, medium or low by the quantile of days of the case's flow (column p_sla)."""
    d, p = F.col("case_duration_days"), F.col("p_sla")
    return F.when(d > s.sla_high * p, "high").when(d > p, "medium").otherwise("low")


def sla_band(cases: DataFrame, s: Settings = Settings()) -> DataFrame:
    limits = group_quantiles(cases, ["flow_type"], "case_duration_days", fine=True, p_sla=("nearest", s.sla_quantile))
    joined = cases.select("case_id", "flow_type", "case_duration_days").join(F.broadcast(limits), "flow_type", "left")  # four flows at most
    return joined.select("case_id", "flow_type", band(s).alias("sla_risk"))


def top_bottlenecks(table: DataFrame, limit: int) -> DataFrame:
    """The bottlenecks with the longest P90 wait and their impact, count times median."""
    return (table.filter("is_bottleneck").orderBy(F.desc("p90_wait_hours"), "from_activity", "to_activity").limit(limit)
            .select("from_activity", "to_activity", "transition_count", "p90_wait_hours",
                    F.round(F.col("transition_count") * F.coalesce("median_wait_hours", F.lit(0.0)), 0).alias("impact_score")))


def chart_cap(top: DataFrame, factor: float = 20.0, limit: int = 10) -> DataFrame:
    """Of a top list (some tens of rows) the rows within ``factor`` upper medians of the P90 waits, the longest first."""
    middle = top.agg(F.sort_array(F.collect_list("p90_wait_hours"), asc=False).alias("_l")).select(
        F.expr("try_element_at(_l, cast(floor(size(_l) / 2) as int) + 1)").alias("_m"))
    return (top.crossJoin(F.broadcast(middle)).filter(F.col("p90_wait_hours") <= factor * F.col("_m"))  # middle: one row
            .orderBy(F.desc("p90_wait_hours"), "from_activity", "to_activity").limit(limit).drop("_m"))
