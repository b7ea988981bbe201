"""Bloom bitmaps in DataFrame functions: built by aggregation, looked up by a broadcast join of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of one bitmap row as produced by bitmap_construct_agg (Spark's fixed size).
BITMAP = 32768
#: Largest filter: 64 MiB of bits, so what is broadcast never grows beyond that.
MAX_CELLS = 1 << 29


def cells_for(n_rows: int, bits_per_row: int = 16, max_cells: int = MAX_CELLS) -> int:
    """Cells of a filter: a power of two, ``bits_per_row`` a row, at most ``max_cells``."""
    want = max(BITMAP, n_rows * bits_per_row)
    return min(max_cells, 1 << (want - 1).bit_length())


def bitmap(cells: DataFrame) -> DataFrame:
    """(bucket, bits) of the set cells in column ``cell``."""
    return (cells.groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits")))


def looked_up(df: DataFrame, bits: DataFrame, cell: Column, flag: str) -> DataFrame:
    """``df`` with the boolean column ``flag``: is the cell set?"""
    side = F.broadcast(bits.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_cell) div 8 as int) + 1, 1)), 16, 10) as int)"
    return (df.withColumn("_cell", cell).withColumn("_at", F.expr("bitmap_bucket_number(_cell)"))
            .join(side, F.col("_at") == F.col("_bucket"), "left")
            .withColumn(flag, F.expr(f"_bits is not null and ({byte} & shiftleft(1, cast(bitmap_bit_position(_cell) % 8 as int))) <> 0"))
            .drop("_cell", "_at", "_bucket", "_bits"))
