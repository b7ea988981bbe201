"""Tables in and out: parquet, JSON mapping, existence gate, writers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Does a path exist in its file system, whichever that is?"""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or one temporary folder a session where all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_millrace_scratch", None)
        if not path:
            path = spark._millrace_scratch = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several branches of a query read is computed once."""
    path = f"{scratch(df.sparkSession)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/millrace/" in folder:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def missing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The inputs that are not there: the gate before a phase."""
    return [p for p in paths if not exists(spark, p)]


def stage_mapping(spark: SparkSession, path: str) -> dict[str, str]:
    """Activity -> stage from a JSON document with an object ``mapping`` (a small dimension)."""
    row = spark.read.option("multiLine", True).json(path).select(F.to_json("mapping").alias("j")).first()
    pairs = spark.range(1).select(F.explode(F.from_json(F.lit(row.j), "map<string,string>")).alias("k", "v")).collect()
    return {r.k: r.v for r in pairs}


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    cols = list(partition_by)
    (writer.partitionBy(*cols) if cols else writer).parquet(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """Write a one-row table as one JSON document (a report, not a data set); text is UTF-8, dates are ISO."""
    df.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"}).alias("value")).coalesce(1) \
        .write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Write a short report made on the driver."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
