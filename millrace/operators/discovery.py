"""How the process flows: variants, transitions, directly-follows graph, rework."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expr import HOUR, group_quantiles, map_value, value_at, with_places
from millrace.model import STAGE_NAMES, UNKNOWN_STAGE, Settings
from millrace.operators.enrich import REPEATS, case_facts
from millrace.sources.tables import written


def variant_stats(cases: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row a variant: cases, share, length, days, dominant flow, happy path (most frequent of its dominant flow).

    All of it follows from one table of (variant, flow, days) with counts, dealt by variant once: counts, dominant flow and both
    quantiles share that partitioning.  The table is written, since the happy paths and the total read it too.
    """
    base = written(cases.groupBy("variant_id", "flow_type", "case_duration_days").agg(F.count("*").alias("_n"), F.min("activity_sequence").alias("_s")), "variants")
    rows = with_places(base.repartition("variant_id"), ["variant_id"], "case_duration_days").withColumn(
        "_f", F.sum("_n").over(Window.partitionBy("variant_id", "flow_type")))
    days = lambda q: value_at(F.round((F.col("_total") - 1) * F.lit(q)).cast("long"), "case_duration_days")
    middle = (F.col("_total") - 1) * F.lit(0.5)
    counts = rows.groupBy("variant_id").agg(
        F.sum("_n").alias("case_count"), F.min("_s").alias("activity_sequence"),
        F.min(F.struct((-F.col("_f")).alias("n"), "flow_type"))["flow_type"].alias("dominant_flow_type"),
        ((value_at(F.floor(middle), "case_duration_days") + value_at(F.ceil(middle), "case_duration_days")) / 2).alias("median_duration_days"),
        days(s.quantile).alias("p90_duration_days"))
    per_flow = base.groupBy("variant_id", "flow_type").agg(F.sum("_n").alias("_n"))
    own = happy_variants(per_flow).select(F.col("flow_type").alias("_flow"), F.col("variant_id").alias("_happy"))
    total = base.agg(F.sum("_n").alias("_all"))
    out = (counts.crossJoin(F.broadcast(total))  # total: one row
           .withColumns({"case_percentage": 100.0 * F.col("case_count") / F.col("_all"), "variant_length": F.size("activity_sequence")}))
    return (out.join(F.broadcast(own), (F.col("_flow") == F.col("dominant_flow_type")) & (F.col("_happy") == F.col("variant_id")), "left")  # a row for each of the four flows
            .withColumn("is_happy_path", F.col("_happy").isNotNull())
            .select("variant_id", "case_count", "activity_sequence", "dominant_flow_type", "median_duration_days", "p90_duration_days",
                    "case_percentage", "variant_length", "is_happy_path"))


def happy_variants(per_flow: DataFrame) -> DataFrame:
    """Most frequent variant of each flow, the smaller id of equals."""
    return per_flow.groupBy("flow_type").agg(F.min(F.struct((-F.col("_n")).alias("n"), "variant_id"))["variant_id"].alias("variant_id"))


def happy_paths(cases: DataFrame) -> DataFrame:
    """variant_id of the variants that are the most frequent of their own dominant flow: one for each of the four flows at most."""
    per_flow = cases.groupBy("variant_id", "flow_type").agg(F.count("*").alias("_n"))
    dominant = per_flow.groupBy("variant_id").agg(F.min(F.struct((-F.col("_n")).alias("n"), "flow_type"))["flow_type"].alias("_flow"))
    top = happy_variants(per_flow)
    return top.join(dominant, "variant_id").filter(F.col("_flow") == F.col("flow_type")).select("variant_id").distinct()


def case_happy_path(cases: DataFrame, variants: DataFrame) -> DataFrame:
    """case_id and is_happy_path of its variant; cases without a variant are not."""
    return (cases.select("case_id", "variant_id").join(variants.select("variant_id", "is_happy_path"), "variant_id", "left")
            .select("case_id", F.coalesce("is_happy_path", F.lit(False)).alias("is_happy_path")))


def transitions(log: DataFrame) -> DataFrame:
    """Consecutive events of a case with the wait in hours (whole seconds); negative waits are left out."""
    out = (log.filter(F.col("next_ts").isNotNull())
           .withColumn("wait_hours", F.col("seconds_to_next") / F.lit(HOUR)).filter("wait_hours >= 0"))
    extra = ["flow_type"] if "flow_type" in log.columns else []
    return out.select("case_id", F.col("activity").alias("from_activity"), F.col("next_activity").alias("to_activity"),
                      F.col("ts").alias("from_ts"), F.col("next_ts").alias("to_ts"), "wait_hours", "is_business_hours", *extra)


def edges(steps: DataFrame, keys: list[str], s: Settings = Settings(), fine: bool = False) -> DataFrame:
    """Counts and waits of transitions by ``keys`` in one pass; ``fine`` for waits in microseconds."""
    return group_quantiles(steps, keys, "wait_hours", fine, transition_count=("count", 0), max_wait_hours=("max", 0),
                           median_wait_hours=("linear", 0.5), p90_wait_hours=("nearest", s.quantile)).select(
        *keys, "transition_count", "max_wait_hours", "median_wait_hours", "p90_wait_hours")


def dfg_edges(steps: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The directly-follows graph."""
    return edges(steps, ["from_activity", "to_activity"], s)


def dfg_nodes(graph: DataFrame, profile: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All end points of the edges with stage, frequency and median seconds to the next event."""
    names = graph.select(F.col("from_activity").alias("activity")).union(graph.select("to_activity")).distinct()
    stage = map_value(s.stages, F.col("activity"), UNKNOWN_STAGE)
    return (names.join(profile.select("activity", "frequency", "median_duration_to_next"), "activity", "left")
            .withColumns({"stage": stage, "stage_name": stage_name(stage)}))


def stage_name(stage: Column) -> Column:
    """Label of a stage code; codes without one stand for themselves."""
    return F.coalesce(map_value(STAGE_NAMES, stage, ""), stage) if not STAGE_NAMES else F.when(
        map_value(STAGE_NAMES, stage, "") != "", map_value(STAGE_NAMES, stage, "")).otherwise(stage)


def dfg_by_flow(log: DataFrame, cases: DataFrame, min_count: int, s: Settings = Settings()) -> DataFrame:
    """Edges of every flow with at least ``min_count`` transitions; microsecond waits, negative ones stay."""
    steps = (log.filter(F.col("next_ts").isNotNull())
             .select("case_id", F.col("activity").alias("from_activity"), F.col("next_activity").alias("to_activity"),
                     (F.expr("timestampdiff(MICROSECOND, ts, next_ts)") / F.lit(3.6e9)).alias("wait_hours"))
             .join(cases.select("case_id", "flow_type"), "case_id"))
    return edges(steps, ["flow_type", "from_activity", "to_activity"], s, fine=True).filter(F.col("transition_count") >= min_count)


def rework(log: DataFrame) -> DataFrame:
    """Per case: activities that occur more than once, repeats beyond the first, flag, largest number of repeats."""
    return case_facts(log).select("case_id", *REPEATS)


def top_variants(variants: DataFrame, checked: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent variants with their own mean compliance and the global one; checked: cases with their scores."""
    own = written(checked.groupBy("variant_id").agg(F.avg("compliance_score").alias("variant_compliance"), F.sum("passed_checks").alias("_passed"),
                                                    F.sum("total_checks").alias("_total")), "variant-scores")  # a row a variant: theirs and the global rate
    rate = own.agg((F.sum("_passed") / F.sum("_total")).alias("compliance_rate"))
    top = variants.orderBy(F.desc("case_count"), "variant_id").limit(limit)
    return (top.join(own.drop("_passed", "_total"), "variant_id", "left").crossJoin(F.broadcast(rate))  # rate: one row
            .withColumn("activities", F.array_join("activity_sequence", "|"))
            .select("variant_id", "case_count", "case_percentage", "variant_length", "is_happy_path", "dominant_flow_type",
                    "median_duration_days", "activities", "variant_compliance", "compliance_rate"))


def variant_concentration(variants: DataFrame, tops: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Share of cases (percent) that the k most frequent variants cover."""
    total = variants.agg(F.sum("case_count").alias("_all"))
    head = variants.orderBy(F.desc("case_count"), "variant_id").limit(max(tops)).select("case_count", "variant_id")
    ranked = head.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("case_count"), "variant_id")))  # max(tops) rows
    parts = F.array(*[F.struct(F.lit(k).alias("top"), (F.col("_rank") <= k).alias("_in")) for k in tops])
    return (ranked.select("case_count", F.explode(parts).alias("p")).filter("p._in").groupBy(F.col("p.top").alias("top_n"))
            .agg(F.sum("case_count").alias("covered_cases")).crossJoin(F.broadcast(total))  # total: one row
            .select("top_n", "covered_cases", (100.0 * F.col("covered_cases") / F.col("_all")).alias("concentration_pct")))

