"""XES event logs (XML) read with Spark's XML source: one row a trace, events exploded with their position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "array<struct<_key:string,_value:string>>"
KINDS = ("string", "date", "float", "int", "boolean", "id")
SCHEMA = ", ".join([f"`{k}` {ITEMS}" for k in KINDS] + ["`event` array<struct<" + ",".join(f"`{k}`:{ITEMS}" for k in KINDS) + ">>"])

# Attribute names of the log and the columns they become.
EVENT_ATTRIBUTES = {
    "concept:name": "activity", "time:timestamp": "timestamp", "org:resource": "resource", "User": "user",
    "Cumulative net worth (EUR)": "event_value",
}
CASE_ATTRIBUTES = {
    "concept:name": "case_id", "Purchasing Document": "purchasing_document", "Item": "item", "Item Type": "item_type",
    "GR-Based Inv. Verif.": "gr_based_iv", "Goods Receipt": "goods_receipt", "Source": "source_system",
    "Purch. Doc. Category name": "doc_category_name", "Company": "company", "Spend classification text": "spend_classification",
    "Spend area text": "spend_area", "Sub spend area text": "sub_spend_area", "Vendor": "vendor", "Name": "vendor_name",
    "Document Type": "document_type", "Item Category": "item_category",
}


def _attributes(prefix: str) -> Column:
    """All attributes of a trace or event as one map; the last of a repeated key wins."""
    each = F.concat(*[F.coalesce(F.col(f"{prefix}`{k}`"), F.expr(f"cast(array() as {ITEMS})")) for k in KINDS])
    pairs = F.filter(each, lambda x: x["_key"].isNotNull())
    return F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"),
                       lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["_key"]), F.create_map(x["_key"], x["_value"])))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """A row a trace with ``_place``, its position in the log: file, block of the file, order within the block."""
    rows = spark.read.format("xml").option("rowTag", "trace").schema(SCHEMA).load(path)
    return rows.withColumn("_place", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))


def bronze_events(traces: DataFrame) -> DataFrame:
    """case_id, activity, timestamp (UTC), resource, user, event_value, event_seq; odd numbers become null."""
    flat = (traces.select(_attributes("").alias("c"), F.posexplode("event").alias("event_seq", "e"))
            .select(F.col("c")["concept:name"].alias("case_id"), F.col("event_seq").cast("long"), _attributes("e.").alias("a")))
    named = flat.select("case_id", "event_seq", *[F.col("a")[k].alias(v) for k, v in EVENT_ATTRIBUTES.items()])
    return named.select("case_id", "activity", F.try_to_timestamp(F.col("timestamp")).alias("timestamp"), "resource", "user",
                        F.expr("try_cast(event_value as double)").alias("event_value"), "event_seq")


def bronze_cases(traces: DataFrame) -> DataFrame:
    """One row a case with its attributes; of traces that share an id the first of the log stays."""
    named = traces.select("_place", _attributes("").alias("c")).select("_place", *[F.col("c")[k].alias(v) for k, v in CASE_ATTRIBUTES.items()])
    typed = named.withColumns({c: F.expr(f"try_cast({c} as boolean)") for c in ("gr_based_iv", "goods_receipt")})
    rest = [c for c in typed.columns if c not in ("case_id", "_place")]
    return typed.groupBy("case_id").agg(F.min_by(F.struct(*rest), "_place").alias("s")).select("case_id", "s.*")


def _escaped(c: Column) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def _item(kind: str, key: str, value: Column) -> Column:
    """An attribute element; nothing for null."""
    return F.coalesce(F.concat(F.lit(f'<{kind} key="{key}" value="'), _escaped(value.cast("string")), F.lit('"/>')), F.lit(""))


def _in_log(batches):
    """Each file is a document of its own: a log element around its traces."""
    import pyarrow as pa

    def row(text):
        return pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])

    yield row('<?xml version="1.0" encoding="UTF-8"?>')
    yield row("<log>")
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])
    yield row("</log>")


def write_xes(events: DataFrame, path: str) -> None:
    """Write an event log (case_id, activity, ts, event_seq, resource, event_value) as XES: one trace a line, one file a task."""
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    event = F.concat(F.lit("<event>"), _item("string", "concept:name", F.col("activity")), _item("date", "time:timestamp", time),
                     _item("string", "org:resource", F.col("resource")), _item("float", "Cumulative net worth (EUR)", F.col("event_value")), F.lit("</event>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_seq", event.alias("e")))), lambda x: x["e"]), "")
    traces = events.groupBy("case_id").agg(body.alias("b"))
    line = F.concat(F.lit("<trace>"), _item("string", "concept:name", F.col("case_id")), F.col("b"), F.lit("</trace>"))
    traces.select(line.alias("value")).mapInArrow(_in_log, "value string").write.mode("overwrite").text(path)
