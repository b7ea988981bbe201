"""The generic ``events`` table seen as an event log, with case attributes from customer, nation and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import Roles, Settings
from millrace.sources.tables import test_table

#: Parts that the five event types play, their stages, and thresholds for a log of one month.
ROLES = Roles(create="signup", receipt=("view",), invoice="click", clear="purchase",
              invoice_set=("click", "purchase"), terminal_set=("purchase", "error"))
STAGES = {"signup": "S1", "view": "S4", "click": "S5", "purchase": "S7", "error": "S8"}
SETTINGS = Settings(roles=ROLES, stages=STAGES, bottleneck_hours=12.0, min_transitions=50, min_transitions_by_flow=10, dataset_months=1.0)

CASE_ID = "concat(cast(user_id as string), '_', cast(cast(ts as date) as string))"
K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, activity, ts, event_seq, resource, event_value."""
    raw = test_table(spark, sf_dir, "events")
    return raw.select(
        F.expr(CASE_ID).alias("case_id"), F.col("event_type").alias("activity"), "ts", F.col("event_id").alias("event_seq"),
        F.expr(f"case when {K} < 15 then concat('batch_', lpad(cast({K} as string), 2, '0')) "
               f"when {K} < 75 then concat('user_', lpad(cast({K} as string), 3, '0')) else 'NONE' end").alias("resource"),
        F.col("value").alias("event_value"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a case with its attributes."""
    ids = test_table(spark, sf_dir, "events").select(F.expr(CASE_ID).alias("case_id"), "user_id").distinct()
    customer, nation, region = (test_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    who = (customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nation, region: fixed 25 and 5 rows
           .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("c_custkey", "c_mktsegment", "n_name", "r_name"))
    category = F.expr("""case c_mktsegment when 'AUTOMOBILE' then '3-way match, invoice after GR'
        when 'BUILDING' then '3-way match, invoice before GR' when 'FURNITURE' then '2-way match'
        when 'HOUSEHOLD' then 'Consignment' when 'MACHINERY' then 'Framework' end""")
    return ids.join(who, F.col("c_custkey") == F.col("user_id"), "left").select(
        "case_id", F.expr("concat('DOC', cast(user_id % 100 as string))").alias("purchasing_document"),
        F.expr("element_at(array('Consignment','Limit','Service','Standard','Subcontracting','Third-party'), cast(user_id % 6 as int) + 1)").alias("item_type"),
        F.expr("user_id % 2 = 0").alias("gr_based_iv"), F.expr("user_id % 3 = 0").alias("goods_receipt"),
        F.col("r_name").alias("company"), F.col("n_name").alias("vendor"), F.lower("n_name").alias("vendor_name"),
        F.expr("element_at(array('EC Purchase order','Framework order','Standard PO'), cast(user_id % 3 as int) + 1)").alias("document_type"),
        category.alias("item_category"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second log without times: case = conversation, activity = role, order = turn."""
    return test_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("activity"), F.col("turn").alias("event_seq"))
