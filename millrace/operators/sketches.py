"""A profile that can be kept and merged: sketches by day and column instead of a look at all events again.

Distinct values by HyperLogLog (2^14 registers: standard error 0.8 %), quantiles by KLL (k 400: rank error under 1 % with 99 %
confidence); counts, nulls and bounds are exact.  A day's sketches have a fixed size whatever its events; a range of days is a merge
of its rows, and a day that is added or corrected reads and rewrites that day only.  The exact profile stays in ``quality``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTERS_LOG2, KLL_K = 14, 400
#: What the estimates keep to: three standard errors of distinct counts, the rank of a quantile.
DISTINCT_ERROR, RANK_ERROR = 0.025, 0.015
DISCRETE, NUMERIC = ("case_id", "activity", "resource"), ("event_value", "time_since_prev_event")
PARTS = ("rows", "nulls", "low", "high", "distinct_sketch", "quantile_sketch")


def _parts(c: str, numeric: bool) -> Column:
    value = F.col(c).cast("double") if numeric else None
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"),
        (F.min(value) if numeric else none).alias("low"), (F.max(value) if numeric else none).alias("high"),
        F.hll_sketch_agg(F.col(c).cast("string"), F.lit(REGISTERS_LOG2)).alias("distinct_sketch"),
        (F.kll_sketch_agg_double(value, F.lit(KLL_K)) if numeric else F.lit(None).cast("binary")).alias("quantile_sketch"))


def daily(log: DataFrame, discrete: Sequence[str] = DISCRETE, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """date, column and the parts of its sketch: one row a day and column, from one partial aggregate by day.

    Nulls are counted and enter no sketch; events without a date are a day of their own (null).
    """
    columns = [(c, False) for c in discrete] + [(c, True) for c in numeric]
    wide = log.groupBy("date").agg(*[_parts(c, n).alias(f"s{k}") for k, (c, n) in enumerate(columns)])
    return wide.select("date", F.explode(F.array(*[f"s{k}" for k in range(len(columns))])).alias("s")).select("date", "s.*")


def merged(days: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """column, rows, nulls, low, high, distinct, p50, p90 and p99 of the days from ``first`` to ``last``: sketches only are read."""
    if first is not None:
        days = days.filter(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.filter(F.col("date") <= F.lit(last).cast("date"))
    one = days.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("quantile_sketch").alias("_q"))
    # a merge of nothing is an empty sketch, which has no quantile
    at = lambda q: F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("_q", F.lit(q)))
    return one.select("column", "rows", "nulls", "low", "high", F.hll_sketch_estimate("_d").alias("distinct"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


def keep(log: DataFrame, path: str) -> None:
    """Write the sketches of the days in ``log`` under ``path``; other days stay as they are."""
    daily(log).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The days written before, to be merged; a range reads its own days' folders only."""
    return spark.read.parquet(path)


def within_bounds(log: DataFrame, found: DataFrame, numeric: Sequence[str] = NUMERIC, discrete: Sequence[str] = DISCRETE) -> DataFrame:
    """column, rows, nulls, distinct_within, median_within: do the estimates keep to their bounds against the exact values?"""
    parts = []
    for c in [*discrete, *numeric]:
        exact = log.agg(F.count_distinct(c).alias("_n"))
        row = found.filter(F.col("column") == c).crossJoin(F.broadcast(exact))  # one row each
        if c in numeric:
            p50 = F.broadcast(found.filter(F.col("column") == c).select("p50"))  # one row
            ranks = log.filter(F.col(c).isNotNull()).crossJoin(p50).agg(
                F.avg((F.col(c) < F.col("p50")).cast("double")).alias("_below"), F.avg((F.col(c) <= F.col("p50")).cast("double")).alias("_upto"))
            row = row.crossJoin(F.broadcast(ranks))
            fits = F.coalesce((F.col("_below") <= 0.5 + RANK_ERROR) & (F.col("_upto") >= 0.5 - RANK_ERROR), F.col("p50").isNull())
        else:
            fits = F.lit(None).cast("boolean")
        parts.append(row.select("column", "rows", "nulls", (F.abs(F.col("distinct") - F.col("_n")) <= DISTINCT_ERROR * F.col("_n") + 1).alias("distinct_within"), fits.alias("median_within")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
