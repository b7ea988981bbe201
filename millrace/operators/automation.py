"""Which activities are worth automating: six normalised scores and their weighted sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expr import clip, entropy_of_counts, group_quantiles
from millrace.model import Settings
from millrace.sources.tables import written


def by_case_and_activity(log: DataFrame) -> DataFrame:
    """One row a case and activity: counts, mean position, rework of the case.

    The log is partitioned by case already, so neither this grain nor the window over a case moves a row.
    """
    each = log.groupBy("case_id", "activity").agg(
        F.count("*").alias("_n"), F.count_if(F.col("resource_type") == "batch").alias("_batch"), F.count_if(F.col("resource_type") == "human").alias("_human"),
        F.avg("event_order").alias("_place"))
    return each.withColumn("_rework", F.max("_n").over(Window.partitionBy("case_id")) > 1)


def automation_base(log: DataFrame) -> DataFrame:
    """Counts, spread of positions and share of rework by activity from one aggregate; mean, deviation and median of its waits in minutes."""
    c = F.col
    out = by_case_and_activity(log).groupBy("activity").agg(
        F.sum("_n").alias("total_count"), F.sum("_batch").alias("batch_count"), F.sum("_human").alias("human_count"), F.count("*").alias("case_count"),
        F.avg("_place").alias("_m"), F.stddev_samp("_place").alias("_sd"), F.sum(F.when(c("_rework"), c("_n")).otherwise(0)).alias("_again"))
    out = out.select(
        "activity", "total_count", "batch_count", "human_count", "case_count", (c("batch_count") / c("total_count")).alias("batch_ratio"),
        F.when(c("_m") > 0, c("_sd") / c("_m")).otherwise(0.0).alias("position_cv"), (c("_again") / c("total_count")).alias("error_rate"))
    waits = log.select("activity", (F.col("time_since_prev_event") / F.lit(60.0)).alias("wait_minutes"))
    moments = waits.groupBy("activity").agg(F.avg("wait_minutes").alias("avg_wait_minutes"), F.stddev_samp("wait_minutes").alias("std_wait_minutes"))
    median = group_quantiles(waits, ["activity"], "wait_minutes", fine=True, median_wait_minutes=("linear", 0.5))
    return out.join(moments, "activity", "left").join(median, "activity", "left")


def activity_pairs(log: DataFrame) -> DataFrame:
    """Counts of neighbouring activities: both entropies come from it."""
    return log.filter("next_activity is not null").groupBy("activity", "next_activity").agg(F.count("*").alias("_c"))


def predecessor_entropy(log: DataFrame) -> DataFrame:
    pairs = activity_pairs(log).filter("activity is not null").withColumnsRenamed({"activity": "_before", "next_activity": "activity"})
    return entropy_of_counts(pairs, ["activity"], "predecessor_entropy")


def successor_entropy(log: DataFrame) -> DataFrame:
    return entropy_of_counts(activity_pairs(log), ["activity"], "successor_entropy")


def position_cv(log: DataFrame) -> DataFrame:
    """Spread over mean of an activity's mean position by case; 0 where the mean is not positive, null for one case."""
    return automation_base(log).select("activity", "position_cv")


def error_rate(log: DataFrame) -> DataFrame:
    """Share of an activity's events that lie in a case with rework."""
    return automation_base(log).select("activity", "error_rate")


def automation_score(log: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row an activity: inputs, six scores, weighted score, tier and hours saved a month."""
    row = automation_base(log).join(predecessor_entropy(log), "activity", "left").join(successor_entropy(log), "activity", "left")
    row = row.na.fill(0.0, ["predecessor_entropy", "successor_entropy", "position_cv", "error_rate"])
    base = written(row, "automation")  # a row an activity, read for the bounds and for the scores
    bounds = base.agg(F.min("total_count").alias("_lo"), F.max("total_count").alias("_hi"), F.max("avg_wait_minutes").alias("_wait"))
    row = base.crossJoin(F.broadcast(bounds))  # bounds: one row
    c = F.col
    median = c("median_wait_minutes")
    row = row.withColumns({
        "volume_score": F.when(c("_hi") > c("_lo"), (c("total_count") - c("_lo")) / (c("_hi") - c("_lo"))).otherwise(0.5),
        "batch_gap_score": 1 - c("batch_ratio"),
        "input_uniformity_score": 1 - clip((c("predecessor_entropy") + c("successor_entropy") + c("position_cv")) / 3, 0.0, 1.0),
        "timing_regularity_score": F.when(median.isNull() | (median <= 0), 1.0).otherwise(1 - clip(c("std_wait_minutes") / median, 0.0, 1.0)),
        "error_reduction_score": clip(c("error_rate") * 2, 0.0, 1.0),
        "wait_reduction_score": F.when(c("_wait") > 0, F.coalesce(c("avg_wait_minutes"), F.lit(0.0)) / c("_wait")).otherwise(0.0),
    })
    names = ("volume_score", "batch_gap_score", "input_uniformity_score", "timing_regularity_score", "error_reduction_score", "wait_reduction_score")
    score = sum((F.lit(w) * c(n) for w, n in zip(s.weights[1:], names[1:])), F.lit(s.weights[0]) * c(names[0]))
    quick, medium, complex_ = s.tiers
    row = row.withColumn("automation_score", score)
    tier = (F.when(c("batch_ratio") >= s.already_batch, "not_recommended").when(c("automation_score") >= quick, "quick_win")
            .when(c("automation_score") >= medium, "medium_effort").when(c("automation_score") >= complex_, "complex").otherwise("not_recommended"))
    hours = c("human_count") / s.dataset_months * clip(median, 0.0, s.human_minutes_cap) / 60.0
    return row.select("activity", "total_count", "batch_ratio", "human_count", "case_count", "median_wait_minutes", *names, "error_rate",
                      "automation_score", tier.alias("automation_tier"), hours.alias("hours_saved_per_month"))


def tier_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy("automation_tier").agg(F.count("*").alias("activities"))
