"""A corpus filter built from the operators of millrace.llm: STAGES and run().

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``.  Null texts count as empty, empty tables pass through.  Where ids repeat or are null, every row is a document
of its own, in order of id (null last) and text; only rows equal in id and text share the verdict on their lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, minhash_dedup, sentencepiece_fst, toxicity
from millrace.llm.common import partitions, small_batches, staged, table
from millrace.llm.queries import tokenizer_bytes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, an id that no two rows share: doc_id, or the place in order of id and text where ids repeat or are null."""
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    order = [F.asc_nulls_last("doc_id"), *[c for c in COLUMNS if c != "doc_id"]]
    sorted_ = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return staged(sorted_.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # written: the numbers must not change


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject.

    Row-local: a null or empty text has margin 0 and stays unless the thresholds say otherwise; equal texts share their verdict whatever
    their ids; a null id is scored like any other.
    """
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, keep=COLUMNS).filter("not rejected").select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; one that loses all it had was a copy and goes, others stay.

    Earlier is by id, then text (its hash), then place.  Empty and blank texts lose nothing and stay, a null text as it is.  Rows of
    one id and one text are one document here: both keep or lose the same lines, so exact repeats with their id stay for the next stage.
    """
    small_batches(spark)
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS)).filter(r"n_removed = 0 or text rlike '\\S'")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (five words, 80 percent)."""
    small_batches(spark)
    rows = with_row(docs)
    kept = minhash_dedup.near_duplicates(rows, id_col="_row").filter("kept").select(F.col("doc_id").alias("_kept"))
    return rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item.

    A null or empty text leaks nothing; rows that repeat an id are judged one by one; equal texts share their verdict.
    """
    small_batches(spark)
    rows = with_row(docs)
    hits = decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    leaks = hits.select(F.col("doc_id").alias("_leak")).distinct()
    return rows.join(leaks, F.col("_row") == F.col("_leak"), "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece encoding of every document that is left, and whether it decodes to the text.

    A null text is encoded as the empty one; a repeated row is encoded again.
    """
    small_batches(spark)
    return sentencepiece_fst.encode_documents(docs, tokenizer_bytes())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("near-copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: No stage order here is expressible in SQL (model scoring, tokenisation); tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
