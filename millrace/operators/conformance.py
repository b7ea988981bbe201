"""Where cases break rules: nine rules as instances of a few templates over one aggregate row a case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expr import distinct_with_null, fixed, group_quantiles
from millrace.model import Settings


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    severity: str


# The catalogue.
RULES = {r.rule_id: r for r in (
    Rule("CR-001", "GR before invoice clearance", "critical"),
    Rule("CR-002", "GR required before payment (invoice-before-GR flow)", "critical"),
    Rule("CR-003", "No invoice activities on consignment", "warning"),
    Rule("CR-005", "Create PO Item is first event", "warning"),
    Rule("CR-006", "Invoice received before clearance", "critical"),
    Rule("CR-007", "Single vendor per purchasing document", "info"),
    Rule("CR-008", "Throughput time within P95", "warning"),
    Rule("CR-009", "No excessive rework (activity repeated > 2 times)", "warning"),
    Rule("CR-010", "Proper closure (terminal activity present)", "info"),
)}


def _days(c: Column) -> Column:
    return fixed(c, 1)


def _precedence(before: Column, after: Column, strict: bool, no_before: str, late: str, done: str, no_after: str | None, after_first: bool):
    """passed and detail of "``before`` comes first"; ``after_first``: a missing second event passes before anything else."""
    holds = before < after if strict else before <= after
    steps = [(before.isNull(), False, no_before)]
    if no_after is not None:
        steps.insert(0 if after_first else 1, (after.isNull(), True, no_after))
    passed = detail = None
    for when, ok, text in steps:
        passed = F.when(when, ok) if passed is None else passed.when(when, ok)
        detail = F.when(when, text) if detail is None else detail.when(when, text)
    return passed.otherwise(holds), detail.when(holds, done).otherwise(late)


def flow_limits(cases: DataFrame, s: Settings = Settings()) -> DataFrame:
    """flow_type with the duration quantiles that rules (p95) and SLA bands (p_sla) compare with, all flows spread over many tasks."""
    return group_quantiles(cases, ["flow_type"], "case_duration_days", fine=True, p95=("nearest", s.duration_quantile), p_sla=("nearest", s.sla_quantile))


def with_limits(cases: DataFrame, limits: DataFrame) -> DataFrame:
    """Broadcast: flow_type takes the values of model.FLOW_TYPES only, so the limits have four rows at most."""
    return cases.join(F.broadcast(limits), "flow_type", "left")


def document_vendors(cases: DataFrame) -> DataFrame:
    """Distinct vendors of every purchasing document; null counts as one."""
    return cases.groupBy(F.col("purchasing_document").alias("_doc")).agg(distinct_with_null("vendor").alias("document_vendors"))


def case_checks(cases: DataFrame, attributes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``cases`` with p95, p_sla and ``checks``: the array of all rules in whose scope a case is.

    cases: flow_type, purchasing_document and the columns of enrich.case_facts.  One row a case, two joins: the limits of its
    flow and the vendors of its document.
    """
    roles = s.roles
    row = with_limits(cases, flow_limits(cases, s)).join(
        document_vendors(attributes), F.col("purchasing_document").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    c, flow = F.col, F.col("flow_type")
    gr, ir, clear = c("receipt_ts"), c("invoice_ts"), c("clear_ts")
    ok = "GR precedes clearance (compliant)"
    open_ = "No invoice clearance yet (compliant)"
    late = "Invoice cleared before goods receipt"
    count = F.coalesce(c("invoice_events"), F.lit(0))
    worst = F.coalesce(c("max_repeat"), F.lit(1))
    quick = c("case_duration_days") <= c("p95")
    # The detail texts.
    checks = [
        ("CR-001", flow == "3way_invoice_after_gr",
         *_precedence(gr, clear, True, "No goods receipt found before invoice clearance", late, ok, open_, False)),
        ("CR-002", flow == "3way_invoice_before_gr",
         *_precedence(gr, clear, True, "Invoice cleared without any goods receipt", late, ok, open_, True)),
        ("CR-003", flow == "consignment", count == 0,
         F.when(count == 0, "No invoice activities (compliant)").otherwise(
             F.concat(F.lit("Found "), count.cast("string"), F.lit(" invoice events (e.g. "), F.coalesce(c("first_invoice"), F.lit("")), F.lit(")")))),
        ("CR-005", F.coalesce(c("has_create"), F.lit(False)), c("first_activity") == roles.create,
         F.when(c("first_activity") == roles.create, "Create PO Item is first event (compliant)").otherwise(
             F.concat(F.lit("First event is '"), c("first_activity"), F.lit("'")))),
        ("CR-006", F.coalesce(c("has_clear"), F.lit(False)),
         *_precedence(ir, clear, False, "Invoice cleared without any Record Invoice Receipt event",
                      "Invoice cleared before invoice was recorded", "Invoice receipt precedes clearance (compliant)", None, False)),
        ("CR-007", F.lit(True), c("document_vendors") == 1,
         F.when(c("document_vendors") == 1, "Single vendor per document (compliant)").otherwise(
             F.concat(F.lit("Document has "), c("document_vendors").cast("string"), F.lit(" different vendors")))),
        ("CR-008", F.lit(True), quick,
         F.when(quick, "Duration within P95 (compliant)").otherwise(
             F.concat(F.lit("Duration "), _days(c("case_duration_days")), F.lit("d exceeds P95 "), _days(c("p95")), F.lit("d")))),
        ("CR-009", F.lit(True), worst <= s.max_repeats,
         F.when(worst <= s.max_repeats, "No excessive rework (compliant)").otherwise(
             F.concat(F.lit("An activity repeats "), worst.cast("string"), F.lit(" times")))),
        ("CR-010", F.lit(True), c("terminal_found").isNotNull(),
         F.when(c("terminal_found").isNotNull(), F.concat(F.lit("Terminal activity '"), c("terminal_found"), F.lit("' present")))
         .otherwise("No terminal activity found (case may be open)")),
    ]
    items = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(RULES[i].name).alias("rule_name"), p.alias("passed"),
                               F.lit(RULES[i].severity).alias("severity"), d.alias("detail"), scope.alias("_in")) for i, scope, p, d in checks])
    return row.withColumn("checks", F.filter(items, lambda x: x["_in"])).drop("document_vendors")


def compliance_checks(checked: DataFrame) -> DataFrame:
    """case_id, rule_id, rule_name, passed, severity, detail: a row for each check of case_checks."""
    return checked.select("case_id", F.explode("checks").alias("r")).select(
        "case_id", "r.rule_id", "r.rule_name", "r.passed", "r.severity", "r.detail")


def compliance_scores(checked: DataFrame) -> DataFrame:
    """Per case: share of checks passed (a null check counts as not passed), checks, critical violations, failed rules by name."""
    return checked.select("case_id", *score_columns())


def score_columns() -> list[Column]:
    """The scores of a case from its array of checks: no row a check, no shuffle."""
    passed = F.size(F.filter("checks", lambda x: x["passed"])).cast("long")
    total = F.size("checks").cast("long")
    failed = F.filter("checks", lambda x: ~x["passed"])
    return [passed.alias("passed_checks"), total.alias("total_checks"),
            F.size(F.filter(failed, lambda x: x["severity"] == "critical")).cast("long").alias("critical_violations"),
            F.array_sort(F.transform(failed, lambda x: x["rule_name"])).alias("compliance_flags"), (passed / total).alias("compliance_score")]


def with_scores(checked: DataFrame) -> DataFrame:
    """``checked`` with the scores of its cases, unless it has them."""
    return checked if "compliance_score" in checked.columns else checked.select("*", *score_columns())


def by_rule(checks: DataFrame) -> DataFrame:
    """Compliance rate and violations of each rule."""
    return checks.groupBy("rule_id", "rule_name", "severity").agg(
        F.avg(F.col("passed").cast("double")).alias("compliance_rate"), F.count_if(~F.col("passed")).alias("violations"))


def by_group(scored: DataFrame, *keys: str) -> DataFrame:
    """Mean score, critical violations and cases by attributes of the case."""
    return scored.groupBy(*keys).agg(
        F.avg("compliance_score").alias("compliance_rate"), F.sum("critical_violations").alias("critical_violations"), F.count("*").alias("case_count"))


def top_violating_vendors(scored: DataFrame, limit: int) -> DataFrame:
    """Vendors with most cases that score under one half."""
    return (scored.groupBy("vendor", "vendor_name").agg(F.count_if(F.col("compliance_score") < 0.5).alias("violations"), F.count("*").alias("case_count"))
            .withColumn("violation_rate", F.col("violations") / F.col("case_count"))
            .orderBy(F.desc("violations"), "vendor", "vendor_name").limit(limit))
