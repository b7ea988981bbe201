"""Declared schemas of the report documents: what a dashboard may rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Names and types of the documents' fields.
NODE = "struct<id string, stage string, stage_name string, frequency long, avg_duration_hours double>"
EDGE = "struct<source string, target string, count long, median_wait_hours double, is_bottleneck boolean>"
EVENT = "struct<activity string, timestamp string, resource string, resource_type string, stage string, time_since_prev_hours double>"
DOCUMENTS = {
    "executive_kpis": "total_cases long, total_events long, compliance_rate double, avg_case_duration_days double, rework_rate double, happy_path_rate double, "
                      "touchless_rate double, automation_coverage double, high_sla_risk_rate double, batch_event_share double, sla_risk_distribution map<string, long>, "
                      "monthly_trend array<struct<month string, cases long, compliance_rate double, avg_duration double>>",
    "process_flow": f"nodes array<{NODE}>, edges array<{EDGE}>, by_flow_type map<string, struct<nodes array<{NODE}>, edges array<{EDGE}>>>",
    "variants": "total_variants long, top_variants array<struct<variant_id string, sequence array<string>, case_count long, case_percentage double, "
                "median_duration_days double, p90_duration_days double, compliance_rate double, is_happy_path boolean, dominant_flow_type string>>, "
                "concentration struct<top5_coverage double, top10_coverage double, top20_coverage double>",
    "compliance_summary": "overall_rate double, by_rule array<struct<rule_id string, rule_name string, severity string, pass_rate double, violation_count long>>, "
                          "by_company array<struct<company string, compliance_rate double, case_count long, critical_violations long>>, "
                          "by_flow_type map<string, struct<compliance_rate double, case_count long, top_violation string>>, "
                          "heatmap array<struct<company string, flow_type string, compliance_rate double, case_count long>>, "
                          "monthly_trend array<struct<month string, cases long, compliance_rate double, avg_duration double>>, "
                          "top_violating_vendors array<struct<vendor string, vendor_name string, violation_count long, case_count long, violation_rate double>>",
    "bottlenecks": "transitions array<struct<from_activity string, to_activity string, from_stage string, to_stage string, count long, median_wait_hours double, "
                   "p90_wait_hours double, max_wait_hours double, is_bottleneck boolean, bottleneck_rank int>>, "
                   "top_bottlenecks array<struct<from_activity string, to_activity string, count long, p90_wait_hours double, impact_score double>>",
    "automation_candidates": "activities array<struct<activity string, stage string, total_executions long, human_executions long, batch_ratio double, volume_score double, "
                             "batch_gap_score double, input_uniformity double, timing_regularity double, error_reduction double, wait_reduction double, "
                             "automation_score double, automation_tier string, estimated_hours_saved_monthly double>>",
    "case_summaries": f"total_cases long, sample_cases array<struct<case_id string, flow_type string, company string, vendor string, vendor_name string, duration_days double, "
                      f"event_count long, compliance_score double, has_rework boolean, variant_id string, is_happy_path boolean, sla_risk string, events array<{EVENT}>>>",
    "company_benchmarks": "companies array<struct<company string, case_count long, avg_duration_days double, median_duration_days double, compliance_rate double, "
                          "rework_rate double, touchless_rate double, automation_coverage double, primary_flow_type string, "
                          "radar struct<speed double, compliance double, efficiency double, automation double, volume double>>>, "
                          "peer_comparison_dimensions array<string>",
    "sla_risk": "model_metrics struct<auc_roc double, pr_auc double, precision double, recall double, f1 double, n_train long, n_test long, positive_rate double>, "
                "feature_importance array<struct<feature string, importance double>>, "
                "at_risk_cases array<struct<case_id string, flow_type string, sla_risk_actual string, sla_risk_score double, sla_risk_predicted string>>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DOCUMENTS[name])


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the declared order and types of document ``name``; what is missing or cannot be told apart is an error, before a job runs."""
    want, have = schema(name), {f.name: f.dataType for f in df.schema}
    if lost := [f.name for f in want if f.name not in have]:
        raise ValueError(f"{name} lacks {', '.join(lost)}")
    if more := sorted(set(have) - set(want.fieldNames())):
        raise ValueError(f"{name} has undeclared {', '.join(more)}")
    if wrong := [f.name for f in want if _names(have[f.name]) != _names(f.dataType)]:
        raise ValueError(f"{name}: other fields than declared in {', '.join(wrong)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def _names(data_type):
    """Field names of a type, nested as they are: casts of structs go by place, so names are compared first."""
    if isinstance(data_type, StructType):
        return [(f.name, _names(f.dataType)) for f in data_type]
    inner = getattr(data_type, "elementType", None) or getattr(data_type, "valueType", None)
    return type(data_type).__name__ if inner is not None and not _names(inner) else _names(inner) if inner is not None else None
