"""Which cases risk missing their service level: features, exact split, boosted trees, metrics in SQL terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.model import Settings
from millrace.operators import boosting
from millrace.operators.boosting import Boosting

# Label encodings; anything else is -1.
ENCODINGS = {
    "flow_type": {"2way": 0, "3way_invoice_after_gr": 1, "3way_invoice_before_gr": 2, "consignment": 3},
    "item_type": {"Consignment": 0, "Limit": 1, "Service": 2, "Standard": 3, "Subcontracting": 4, "Third-party": 5},
    "document_type": {"EC Purchase order": 0, "Framework order": 1, "Standard PO": 2},
    "company": {"companyID_0000": 0, "companyID_0001": 1, "companyID_0002": 2, "companyID_0003": 3},
}
FEATURES = ["flow_type_enc", "company_enc", "vendor_freq", "item_type_enc", "document_type_enc", "gr_based_iv", "goods_receipt",
            "start_month", "start_quarter", "start_dow"]


def encoded(name: str, codes: dict[str, int]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.when(F.col(name).isNull(), -1).otherwise(F.coalesce(F.try_element_at(pairs, F.col(name)), F.lit(-1))).alias(f"{name}_enc")


def cohort(summary: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Cases that start in the cohort's years, with the binary target."""
    return summary.filter(F.year("case_start") >= s.cohort_year).withColumn("target", (F.col("sla_risk") != "low").cast("int"))


def stratified_split(cases: DataFrame, share: float = 0.8, seed: str = "42") -> DataFrame:
    """case_id, target, in_test_set: exactly ``share`` of each class trains, chosen by a hash of the id.

    A class is ranked by range: ids are bucketed by their hash and only buckets' counts are cumulated in one place, so
    no task sorts a whole class.
    """
    h = F.md5(F.concat(F.col("case_id"), F.lit(seed)).cast("binary"))
    rows = cases.select("case_id", "target", h.alias("_h")).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy("target", "_b").agg(F.count("*").alias("_n"))  # 4,096 buckets a class
    by = Window.partitionBy("target").orderBy("_b")
    before = counts.withColumns({"_before": F.sum("_n").over(by) - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy("target"))})
    joined = rows.join(F.broadcast(before.drop("_n")), ["target", "_b"])  # 8,192 rows
    rank = F.row_number().over(Window.partitionBy("target", "_b").orderBy("_h", "case_id")) + F.col("_before")
    return joined.select("case_id", "target", (rank > F.round(F.lit(share) * F.col("_all"))).alias("in_test_set"))


def features(cases: DataFrame, split: DataFrame, encodings: dict[str, dict[str, int]] = ENCODINGS) -> DataFrame:
    """Model inputs; a vendor's frequency counts training cases only, unseen vendors count one."""
    rows = cases.join(split.select("case_id", "in_test_set"), "case_id")
    freq = rows.filter("not in_test_set").groupBy(F.col("vendor").alias("_v")).agg(F.count("*").alias("vendor_freq"))
    rows = rows.join(freq, F.col("vendor").eqNullSafe(F.col("_v")), "left")
    return rows.select(
        "case_id", "in_test_set", "target", *[encoded(n, c) for n, c in encodings.items()],
        F.coalesce("vendor_freq", F.lit(1)).cast("int").alias("vendor_freq"),
        *[F.coalesce(F.col(n).cast("int"), F.lit(0)).alias(n) for n in ("gr_based_iv", "goods_receipt")],
        F.month("case_start").alias("start_month"), F.quarter("case_start").alias("start_quarter"), (F.weekday("case_start") + 1).alias("start_dow"))


@dataclass
class SlaModel:
    """The fitted trees, metrics on the held-out rows, and how often and with what gain each feature divides a node."""

    model: boosting.Model
    metrics: dict[str, float]
    importance: DataFrame


def train(rows: DataFrame, how: Boosting = Boosting()) -> SlaModel:
    """Boosted trees of at most 31 leaves with class weights; metrics on the held-out rows, importances by number of splits."""
    model = boosting.train(rows.filter("not in_test_set").select("target", *FEATURES), FEATURES, how=how)
    found = metrics(score(model, rows.filter("in_test_set"))).first().asDict()
    return SlaModel(model, found, importance(boosting.node_table(rows.sparkSession, model)))


def importance(nodes: DataFrame) -> DataFrame:
    """feature, importance (number of splits) and gain, the most used first."""
    used = boosting.importances(nodes, FEATURES).withColumnRenamed("splits", "importance")
    return used.orderBy(F.desc("importance"), F.desc("gain"), "feature")


def score(model: boosting.Model, rows: DataFrame) -> DataFrame:
    """case_id, target, in_test_set, sla_risk_score, sla_risk_predicted."""
    p = 1.0 / (1.0 + F.exp(-F.col("margin")))
    return boosting.margins(rows, model, "case_id", "target", "in_test_set").withColumn("sla_risk_score", p).drop("margin").withColumn(
        "sla_risk_predicted", F.when(F.col("sla_risk_score") >= 0.5, "above_p75").otherwise("below_p75"))


def first_splits(rows: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """Every split of the first tree's root: feature, threshold (values up to it go left), rows on the left, gain.

    Of the same sums as the trees': whole units of gradient and hessian by bin.  No split without rows of both targets.
    """
    return boosting.root_splits(rows.filter("not in_test_set").select("target", *FEATURES), FEATURES, how=how)


def metrics(scored: DataFrame, label: str = "target", value: str = "sla_risk_score", threshold: float = 0.5) -> DataFrame:
    """One row: AUC by rank sums with ties, average precision, precision, recall and F1 at the threshold.

    Rows are counted by score first; scores are cumulated within 4,096 ranges of [0, 1] and the ranges among themselves,
    so no task sorts all scores.
    """
    by_score = scored.groupBy(F.col(value).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("p"))
    by_score = by_score.withColumn("b", F.greatest(F.lit(0), F.least(F.lit(4095), F.floor(F.col("s") * 4096))).cast("int"))
    ranges = by_score.groupBy("b").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    up, down = Window.orderBy("b"), Window.orderBy(F.desc("b"))  # 4,096 rows at most
    ranges = ranges.select("b", (F.sum("bn").over(up) - F.col("bn")).alias("n_low"), (F.sum("bn").over(down) - F.col("bn")).alias("n_high"),
                           (F.sum("bp").over(down) - F.col("bp")).alias("p_high"))
    up, down = Window.partitionBy("b").orderBy("s"), Window.partitionBy("b").orderBy(F.desc("s"))
    cum = by_score.join(F.broadcast(ranges), "b").withColumns({
        "below": F.sum("n").over(up) - F.col("n") + F.col("n_low"), "n_from": F.sum("n").over(down) + F.col("n_high"), "p_from": F.sum("p").over(down) + F.col("p_high")})
    one = cum.agg(
        F.sum("n").alias("n"), F.sum("p").alias("pos"), F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("ranks"),
        F.sum(F.col("p") * F.col("p_from") / F.col("n_from")).alias("ap"),
        F.coalesce(F.sum(F.when(F.col("s") >= threshold, F.col("p"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("s") >= threshold, F.col("n"))), F.lit(0)).alias("called"))
    c = F.col
    neg = c("n") - c("pos")
    return one.select(
        ((c("ranks") - c("pos") * (c("pos") + 1) / 2.0) / F.nullif(c("pos") * neg, F.lit(0))).alias("auc_roc"),
        (c("ap") / F.nullif(c("pos"), F.lit(0))).alias("average_precision"), (c("tp") / F.nullif(c("called"), F.lit(0))).alias("precision"),
        (c("tp") / F.nullif(c("pos"), F.lit(0))).alias("recall"), (2.0 * c("tp") / F.nullif(c("called") + c("pos"), F.lit(0))).alias("f1"))
