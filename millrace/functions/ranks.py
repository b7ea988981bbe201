"""Global ordinal ranks: by range, so that no task holds more than its share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import written

#: monotonically_increasing_id: the partition above, the place within it in the low 33 bits.
PLACE_BITS = 33


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3... over all rows in the given order.

    Rows are dealt by range of all order columns, so ties in the first ones spread as well, and sorted within their range; one
    row a range is cumulated, and every row adds the ranges before its own.  One exchange and one table in the shared folder: the
    places are drawn once, so a lost executor cannot change them.  Rows equal in every order column follow each other in any
    order.  Nulls stand where the columns' own order puts them.  An empty table stays empty.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    place = F.monotonically_increasing_id()
    dealt = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", place), "ranks")
    part, within = F.shiftright("_place", PLACE_BITS), F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    out = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select(*df.columns, (F.col("_before") + within + 1).alias(name))


def top_ranked(df: DataFrame, order: Sequence[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows (a report's bound) with their rank: each task keeps its own first ones before they meet."""
    head = df.orderBy(*order).limit(limit)
    return head.withColumn(name, F.row_number().over(Window.orderBy(*order)))  # limit rows
