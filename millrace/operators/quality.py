"""Data quality: null rates, referential integrity, contracts, gates, profile.  Checks run before anything is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.expr import group_quantiles
from millrace.model import FLOW_TYPES, RESOURCE_TYPES, SILVER_CASES, SILVER_EVENTS, SILVER_MINIMUM, Settings


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``child`` that ``parent`` lacks."""
    return child.select(key).distinct().join(parent.select(key).distinct(), key, "left_anti")


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, null_rate of every column from one aggregation."""
    columns = columns or df.columns
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rate")) for c in columns])).alias("r")).select("r.*")


@dataclass(frozen=True)
class Gate:
    """A condition on aggregates of a table: ``measure`` must hold."""

    name: str
    measure: Column


def run_gates(df: DataFrame, gates: list[Gate]) -> DataFrame:
    """gate, passed of every gate from one aggregation; an undefined measure fails."""
    one = df.agg(*[F.coalesce(g.measure, F.lit(False)).alias(f"g{k}") for k, g in enumerate(gates)])
    items = F.array(*[F.struct(F.lit(g.name).alias("gate"), F.col(f"g{k}").alias("passed")) for k, g in enumerate(gates)])
    return one.select(F.explode(items).alias("r")).select("r.*")


def count_gate(name: str, expected: int | None, tolerance: float) -> list[Gate]:
    return [] if expected is None else [Gate(name, F.abs(F.count("*") - expected) <= tolerance * expected)]


def orphan_gate(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Does every case of the events have a row of its own?"""
    return run_gates(orphans(events.filter("case_id is not null"), cases, "case_id"), [Gate("no_orphan_cases", F.count("*") == 0)])


def bronze_gates(events: DataFrame, cases: DataFrame | None = None, s: Settings = Settings(), max_null_ts: float = 0.001, ts: str = "ts") -> DataFrame:
    """Gates of the raw tables: nulls, activities, and where ``cases`` are given and counts expected, counts and integrity."""
    gates = [
        Gate("case_id_not_null", F.count_if(F.col("case_id").isNull()) == 0),
        Gate("activity_not_null", F.count_if(F.col("activity").isNull()) == 0),
        Gate("timestamp_null_rate", F.avg(F.col(ts).isNull().cast("double")) <= max_null_ts),
        Gate("enough_activities", F.count_distinct("activity") >= s.expected_activities),
    ]
    out = run_gates(events, gates + count_gate("event_count", s.expected_events, s.count_tolerance))
    if cases is not None:
        out = out.unionByName(orphan_gate(events, cases))
        if s.expected_cases is not None:
            out = out.unionByName(run_gates(cases, count_gate("case_count", s.expected_cases, s.count_tolerance)))
    return out


def silver_gates(log: DataFrame, cases: DataFrame, events_before: int | None = None, cases_before: int | None = None, tolerance: float = 0.0) -> DataFrame:
    """Gates of the enriched log and of the case table; with the numbers of raw rows, also that none was lost."""
    return run_gates(log, [
        Gate("resource_type_not_null", F.count_if(F.col("resource_type").isNull()) == 0),
        Gate("resource_type_known", F.count_if(~F.col("resource_type").isin(*RESOURCE_TYPES)) == 0),
        Gate("event_order_positive", F.min("event_order") >= 1),
        *count_gate("events_kept", events_before, tolerance),
    ]).unionByName(run_gates(cases, [
        Gate("flow_type_not_null", F.count_if(F.col("flow_type").isNull()) == 0),
        Gate("flow_type_known", F.count_if(~F.col("flow_type").isin(*FLOW_TYPES.values())) == 0),
        Gate("duration_not_negative", F.coalesce(F.min("case_duration_days"), F.lit(0.0)) >= 0),
        Gate("variant_not_null", F.count_if(F.col("variant_id").isNull() & F.col("event_count").isNotNull()) == 0),
        *count_gate("cases_kept", cases_before, tolerance),
    ]))


def silver_violations(log: DataFrame, cases: DataFrame) -> list[str]:
    """What the silver tables break of their contracts; facts of cases without events may be null."""
    with_events = cases.filter("event_count is not null")
    return (contract_violations(log, SILVER_EVENTS, {"resource_type": list(RESOURCE_TYPES)}, SILVER_MINIMUM)
            + contract_violations(with_events, SILVER_CASES, {"flow_type": list(FLOW_TYPES.values())}, SILVER_MINIMUM))


def anomalies(log: DataFrame) -> int:
    """Events with a time before the log's first sensible year."""
    return log.filter("is_timestamp_anomaly").count()


def contract_violations(df: DataFrame, schema: StructType, allowed: dict[str, list] | None = None, minimum: dict[str, float] | None = None) -> list[str]:
    """What a table breaks of its contract: missing columns, types, nulls, values outside a list, values too small."""
    out, have = [], {f.name: f for f in df.schema}
    for f in schema:
        if f.name not in have:
            out.append(f"{f.name}: missing")
        elif have[f.name].dataType != f.dataType:
            out.append(f"{f.name}: {have[f.name].dataType.simpleString()} instead of {f.dataType.simpleString()}")
    tests = {f"{f.name}: null": F.col(f.name).isNull() for f in schema if not f.nullable and f.name in have}
    tests |= {f"{c}: not allowed": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in (allowed or {}).items() if c in have}
    tests |= {f"{c}: below {v}": F.col(c) < v for c, v in (minimum or {}).items() if c in have}
    if tests:
        found = df.agg(*[F.count_if(t).alias(f"t{k}") for k, t in enumerate(tests.values())]).first()
        out += [name for k, name in enumerate(tests) if found[k]]
    return out


def log_profile(log: DataFrame) -> DataFrame:
    """One row: events, cases, activities, resources, time range, anomalies, events a case (median, P90, P99), value statistics."""
    main = log.agg(
        F.count("*").alias("event_count"), F.count_distinct("case_id").alias("case_count"), F.count_distinct("activity").alias("activity_count"),
        F.count_distinct("resource").alias("resource_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if("is_timestamp_anomaly").alias("anomaly_count"), F.min("event_value").alias("min_value"), F.max("event_value").alias("max_value"),
        F.avg("event_value").alias("mean_value"))
    length = log.groupBy("case_id").agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    lengths = group_quantiles(length, ["_one"], "_n", median_case_length=("linear", 0.5), p90_case_length=("nearest", 0.9), p99_case_length=("nearest", 0.99))
    return main.crossJoin(F.broadcast(lengths.drop("_one")))  # one row each


def frequencies(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """The most frequent values of a column."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def profile_tables(log: DataFrame, cases: DataFrame, s: Settings = Settings()) -> dict[str, DataFrame]:
    """The parts of a profile by title; each has a row a column, a gate or one of the most frequent values."""
    sane = log.filter(~F.col("is_timestamp_anomaly"))
    return {
        "Log": log_profile(log),
        "Time range without anomalies": sane.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")),
        "Null rates of events": null_rates(log, [c for c in log.columns if c in ("case_id", "activity", "ts", "resource", "event_value", "event_seq")]),
        "Null rates of cases": null_rates(cases),
        "Activities": frequencies(log, "activity", 50), "Resources": frequencies(log, "resource"),
        "Item categories": frequencies(cases, "item_category"), "Companies": frequencies(cases, "company"),
        "Gates": bronze_gates(log, cases, s),
    }


def profile_report(log: DataFrame, cases: DataFrame, s: Settings = Settings()) -> str:
    """The profile as Markdown (tables of some tens of rows, put together on the driver)."""
    out = ["# Log profile"]
    for title, df in profile_tables(log, cases, s).items():
        rows = [r.asDict() for r in df.collect()]
        if len(rows) == 1 and title != "Gates":  # one row of measures reads better downwards
            rows = [{"measure": k, "value": v} for k, v in rows[0].items()]
        names = list(rows[0]) if rows else df.columns
        lines = [" | ".join(str(r[n]) for n in names) for r in rows]
        out.append(f"## {title}\n\n" + "\n".join(f"| {x} |" for x in (" | ".join(names), " | ".join("---" for _ in names), *lines)))
    return "\n\n".join(out) + "\n"
