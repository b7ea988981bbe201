"""The phases from raw log to reports, each gated by its inputs and recorded; also the command line.

    python -m millrace.plans.pipeline --all --input log.xes --output-dir out
"""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from millrace.model import BRONZE_CASES, BRONZE_EVENTS, P2P_LOG, Settings
from millrace.operators import boosting, enrich, marts, quality, sla
from millrace.plans import export
from millrace.plans.context import Log
from millrace.plans.together import counted, run_together
from millrace.session import session
from millrace.sources import xes
from millrace.sources.tables import exists, missing, stage_mapping, write_parquet, write_text

log_ = logging.getLogger("millrace")
#: The cases with facts, checks and scores: written first in the gold phase, read by all that follows.
CHECKED = "gold/case_checks"
FOR_EXPORT = ("case_checks", "fact_case_summary", "fact_variant_stats", "fact_compliance_checks", "fact_bottleneck_analysis", "fact_automation_opportunities")
PHASES = ("ingest", "silver", "gold", "analytics", "predict", "export")


@dataclass
class PhaseResult:
    phase: str
    status: str
    seconds: float = 0.0
    rows_written: int = 0
    errors: list[str] = field(default_factory=list)


class Pipeline:
    """Runs phases over one output folder: bronze, silver, gold and export tables below it."""

    def __init__(self, spark: SparkSession, output_dir: str, source: str | None = None, settings: Settings = Settings(),
                 skip_validation: bool = False, trees: int = 300):
        self.spark, self.out, self.source, self.settings = spark, output_dir.rstrip("/"), source, settings
        self.skip_validation, self.trees = skip_validation, trees

    def path(self, table: str) -> str:
        return f"{self.out}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def inputs(self, phase: str) -> list[str]:
        tables = {"silver": ["bronze/events", "bronze/cases"], "gold": ["silver/events", "silver/cases"], "analytics": ["silver/events", "silver/cases"],
                  "predict": ["gold/fact_case_summary"], "export": ["silver/events", "silver/cases", "silver/activities", *(f"gold/{t}" for t in FOR_EXPORT)]}
        return [self.source] if phase == "ingest" else [self.path(t) for t in tables[phase]]

    def run(self, phase: str, dry_run: bool = False) -> PhaseResult:
        if phase not in PHASES:
            raise ValueError(f"unknown phase {phase!r}; one of {', '.join(PHASES)}")
        if phase == "ingest" and not self.source:
            return PhaseResult(phase, "failed", errors=["no input log given"])
        if lost := missing(self.spark, self.inputs(phase)):
            return PhaseResult(phase, "failed", errors=[f"missing input: {p}" for p in lost])
        if dry_run:
            return PhaseResult(phase, "dry-run")
        began = time.time()
        try:
            rows = getattr(self, f"_{phase}")()
            return PhaseResult(phase, "ok", time.time() - began, rows)
        except Exception as error:  # a phase reports its failure, run_all stops there
            return PhaseResult(phase, "failed", time.time() - began, errors=[str(error)[:2000]])

    def run_all(self, dry_run: bool = False) -> list[PhaseResult]:
        results = []
        for phase in PHASES:
            results.append(self.run(phase, dry_run))
            if results[-1].status == "failed" and not dry_run:
                break
        return results

    def _writes(self, tables: dict[str, DataFrame]) -> dict[str, Callable[[], int]]:
        """A job a table that writes it and returns its rows."""
        return {name: lambda name=name, df=df: counted(df, lambda d: write_parquet(d, self.path(name))) for name, df in tables.items()}

    def _write(self, tables: dict[str, DataFrame]) -> int:
        """Write independent tables together; their rows in all."""
        return sum(run_together(self.spark, self._writes(tables)).values())

    def _validate(self, gates: DataFrame, problems: list[str] = ()) -> None:
        if self.skip_validation:
            return
        failed = [r.gate for r in gates.filter("not passed").collect()] + list(problems)
        if failed:
            raise ValueError("quality gates failed: " + ", ".join(failed))

    def _ingest(self) -> int:
        traces = xes.read_traces(self.spark, self.source).persist()
        try:
            events, cases = xes.bronze_events(traces), xes.bronze_cases(traces)
            self._validate(quality.bronze_gates(events, cases, self.settings, ts="timestamp"),
                           quality.contract_violations(events, BRONZE_EVENTS) + quality.contract_violations(cases, BRONZE_CASES))
            rows = self._write({"bronze/events": events, "bronze/cases": cases})
            for table in ("bronze/events", "bronze/cases"):
                log_schema(table, self.read(table))
            return rows
        finally:
            traces.unpersist()

    def _silver(self) -> int:
        events = self.read("bronze/events").withColumnRenamed("timestamp", "ts").drop("user")
        log, raw = enrich.enriched(events, self.settings).persist(), self.read("bronze/cases")
        cases = marts.case_table(raw, enrich.case_facts(log, self.settings.roles)).persist()
        try:
            if not self.skip_validation:
                before = run_together(self.spark, {"events": events.count, "cases": raw.count, "log": log.count, "facts": cases.count})
                found = run_together(self.spark, {
                    "gates": lambda: [r.gate for r in quality.silver_gates(log, cases, before["events"], before["cases"]).filter("not passed").collect()],
                    "contracts": lambda: quality.silver_violations(log, cases), "anomalies": lambda: quality.anomalies(log)})
                if problems := found["gates"] + found["contracts"]:
                    raise ValueError("quality gates failed: " + ", ".join(problems))
                log_.info("timestamp anomalies: %d events", found["anomalies"])
            return self._write({"silver/events": log, "silver/cases": cases, "silver/resources": enrich.resource_profile(log),
                                "silver/activities": enrich.activity_profile(log, self.settings)})
        finally:
            log.unpersist()
            cases.unpersist()

    def context(self) -> Log:
        whole = self.read("silver/cases")
        x = Log(self.read("silver/events"), whole.select(*BRONZE_CASES.fieldNames()), self.settings)
        x.log, x.whole, x.kept = x.events, whole, whole
        return x

    def _gold(self) -> int:
        """All tables together; what needs the checked cases follows that table as soon as it is written."""
        x, s = self.context(), self.settings

        def checked() -> int:
            write_parquet(x.scored, self.path(CHECKED))
            x.checked = x.scored = self.read(CHECKED)
            return self._write({"gold/fact_case_summary": x.summary, "gold/fact_compliance_checks": x.checks})

        rows = sum(run_together(self.spark, {"gold/case_checks": checked} | self._writes({
            "gold/fact_automation_opportunities": x.automation, "gold/fact_bottleneck_analysis": x.bottlenecks, "gold/fact_variant_stats": x.variants,
            "gold/dim_vendor": marts.dim_vendor(x.cases), "gold/dim_company": marts.dim_company(x.cases), "gold/fact_event_log": marts.fact_event_log(x.log, x.cases),
            "gold/dim_activity": marts.dim_activity(self.read("silver/activities"), s), "gold/dim_calendar": marts.dim_calendar(x.log, s),
            "gold/dim_resource": enrich.with_primary(self.read("silver/resources"))})).values())
        x.summary = self.read("gold/fact_case_summary")
        for name, value in export.executive_kpis(x).first().asDict().items():
            log_.info("KPI %s: %s", name, value)
        return rows

    def profile(self) -> str:
        """Write the Markdown profile of the silver tables; returns its text."""
        text = quality.profile_report(self.read("silver/events"), self.read("silver/cases").select(*BRONZE_CASES.fieldNames()), self.settings)
        write_text(self.spark, text, self.path("reports/profile"))
        return text

    def _analytics(self) -> int:
        """The analytics tables are part of gold: nothing to do if they are there."""
        return 0 if exists(self.spark, self.path("gold/fact_automation_opportunities")) else self._gold()

    def _predict(self) -> int:
        chosen = sla.cohort(self.read("gold/fact_case_summary"), self.settings)
        rows = sla.features(chosen, sla.stratified_split(chosen)).persist()
        try:
            fitted = sla.train(rows, boosting.Boosting(trees=self.trees))
            scored = sla.score(fitted.model, rows)
            boosting.save(self.spark, fitted.model, self.path("models/sla_risk"))
            facts = chosen.select("case_id", "flow_type", "sla_risk").join(scored.drop("target"), "case_id")
            export.export_sla(facts, fitted.metrics, fitted.importance, self.path("export"), self.settings.max_scores)
            return self._write({"gold/fact_sla_risk": facts})
        finally:
            rows.unpersist()

    def _export(self) -> int:
        """Reports of the gold tables; only the graph and its flows go back to the log."""
        x = self.context()
        x.checked = x.scored = self.read(CHECKED)
        x.summary, x.variants, x.checks = (self.read(f"gold/{t}") for t in ("fact_case_summary", "fact_variant_stats", "fact_compliance_checks"))
        x.bottlenecks, x.automation, x.profile = self.read("gold/fact_bottleneck_analysis"), self.read("gold/fact_automation_opportunities"), self.read("silver/activities")
        x.graph = x.graph.persist()  # pairs of activities
        try:
            orphans = lambda: not self.skip_validation and not quality.orphans(x.log, x.cases, "case_id").isEmpty()
            if run_together(self.spark, {"graph": x.graph.count, "orphans": orphans})["orphans"]:
                raise ValueError("events without a case")
            return export.export_all(x, self.path("export"))
        finally:
            x.graph.unpersist()


def log_schema(name: str, df: DataFrame) -> None:
    """Columns, types and null rates of a table, as log lines."""
    rates = {r.column_name: r.null_rate for r in quality.null_rates(df).collect()}
    for f in df.schema:
        log_.info("%s %s %s nulls %.1f%%", name, f.name, f.dataType.simpleString(), 100 * (rates[f.name] or 0.0))


def register_views(pipeline: Pipeline) -> list[str]:
    """SQL views over the marts: ``spark.sql`` is the ad-hoc query surface."""
    names = []
    for layer, table in (("silver", t) for t in ("events", "cases", "resources", "activities")):
        names.append(f"{layer}_{table}")
        pipeline.read(f"{layer}/{table}").createOrReplaceTempView(names[-1])
    for table in ("dim_activity", "dim_company", "dim_vendor", "dim_calendar", "dim_resource", "fact_event_log", "fact_variant_stats", "fact_compliance_checks",
                  "fact_bottleneck_analysis", "fact_case_summary", "fact_automation_opportunities"):
        names.append(table)
        pipeline.read(f"gold/{table}").createOrReplaceTempView(table)
    return names


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Process-intelligence pipeline")
    parser.add_argument("--phase", choices=PHASES)
    parser.add_argument("--all", action="store_true")
    parser.add_argument("--input", help="XES log")
    parser.add_argument("--output-dir", default="out")
    parser.add_argument("--skip-validation", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--profile", action="store_true", help="write the Markdown profile of the silver tables")
    parser.add_argument("--stages", help="JSON document with the stage of every activity")
    for name, number in P2P_LOG.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=int, default=number, help=f"{number:,} unless given; 0: any number")
    given = parser.parse_args(args)
    if not (given.all or given.phase or given.profile):
        parser.error("give --phase, --all or --profile")
    logging.basicConfig(level=logging.INFO, format="%(name)s %(message)s")
    spark = session()
    settings = Settings(expected_events=given.expected_events or None, expected_cases=given.expected_cases or None, expected_activities=given.expected_activities or 1)
    if given.stages:
        settings = replace(settings, stages=stage_mapping(spark, given.stages))
    pipeline = Pipeline(spark, given.output_dir, given.input, settings, skip_validation=given.skip_validation)
    if given.profile:
        print(pipeline.profile())
        return 0
    results = pipeline.run_all(given.dry_run) if given.all else [pipeline.run(given.phase, given.dry_run)]
    for r in results:
        print(f"{r.phase}: {r.status}, {r.seconds:.1f} s, {r.rows_written} rows" + "".join(f"\n  {e}" for e in r.errors))
    return int(any(r.status == "failed" for r in results))


if __name__ == "__main__":
    raise SystemExit(main())
