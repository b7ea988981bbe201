"""Exact dedup by two-pass Bloom filtering.

Pass 1 marks every text's digest in two bitmaps, "seen" and "seen twice".  Each task fills its own pair and sends only what it
set, a bucket of cells at a time: as the bits themselves or as 16-bit positions, whichever is shorter.  A bucket's
parts are then merged as a stream: a cell set by two parts, or twice by one, was seen twice.
Pass 2 looks every row up: rows with all cells seen twice are *possibly* repeated and shuffle (digest and id only, never
the text); all others pass straight through with a group of one.

Scale: the filter has ``bits_per_row`` cells a row, at most ``max_cells`` (64 MiB as a bitmap), so what is
broadcast and what a task holds have fixed bounds; beyond it more unique rows take part in the shuffle and results stay
exact.  A text shared by a third of all rows is one bit a task in pass 1 and one pre-aggregated row a task in pass 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bloom import BITMAP, MAX_CELLS, cells_for, looked_up
from millrace.llm.common import partitions, staged, text_or_empty

#: A part of a bucket: its number (as of bitmap_bucket_number, from 1), cells seen and cells seen twice by one task.
PART = "bucket long, seen binary, twice binary"


def _cells(n_cells: int, probes: int):
    """Cells of a digest, from 1, so that whole buckets of bitmap_bucket_number are used."""
    return [F.pmod(F.xxhash64("text_sha256", F.lit(k)), F.lit(n_cells)) + 1 for k in range(probes)]


def _packed(bits: np.ndarray) -> bytes:
    """A bucket's bits: the bitmap itself, or the positions of the set ones where they are shorter (never as long as it)."""
    at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    return at.astype("<u2").tobytes() if 2 * len(at) < len(bits) else bits.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == BITMAP // 8:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(BITMAP, np.uint8)
    bits[np.frombuffer(data, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


def _mark(n_cells: int):
    """Fill this task's two bitmaps and send the buckets in which something is set."""
    def mark(batches):
        seen, twice = (np.zeros(n_cells // 8, np.uint8) for _ in range(2))
        for batch in batches:
            each = batch.column(0).flatten().to_numpy()  # the distinct cells of every row
            cells, times = np.unique(each - 1, return_counts=True)
            byte, bit = cells >> 3, (1 << (cells & 7)).astype(np.uint8)
            again = (times > 1) | (seen[byte] & bit != 0)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(seen, byte, bit)
        width = BITMAP // 8
        for bucket in np.flatnonzero(seen.reshape(-1, width).any(axis=1)).tolist():
            part = slice(bucket * width, (bucket + 1) * width)
            yield pa.RecordBatch.from_arrays([pa.array([bucket + 1], pa.int64()), pa.array([_packed(seen[part])], pa.binary()),
                                              pa.array([_packed(twice[part])], pa.binary())], names=["bucket", "seen", "twice"])

    return mark


def _merge(batches):
    """Streams parts ordered by bucket; (bucket, bits) of the cells seen twice."""
    at, seen, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([twice.tobytes()], pa.binary())], names=["bucket", "bits"])

    for batch in batches:
        for bucket, a, b in zip(*[c.to_pylist() for c in batch.columns]):
            if bucket != at:
                if at is not None:
                    yield out()
                at, seen, twice = bucket, np.zeros(BITMAP // 8, np.uint8), np.zeros(BITMAP // 8, np.uint8)
            a = _unpacked(a)
            twice = twice | _unpacked(b) | (seen & a)
            seen = seen | a
    if at is not None:
        yield out()


def seen_twice(digests: DataFrame, n_cells: int, probes: int) -> DataFrame:
    """(bucket, bits) of the cells that two rows or more of ``digests`` set; at most ``n_cells`` / 8 bytes in all."""
    cells = digests.select(F.array_distinct(F.array(*_cells(n_cells, probes))).alias("cells"))
    parts = cells.mapInArrow(_mark(n_cells), PART)
    n = min(partitions(digests.sparkSession), max(1, n_cells // BITMAP))
    return parts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge, "bucket long, bits binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", probes: int = 2,
                     bits_per_row: int = 16, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  The largest id of a group stays.  Rows repeated with
    the same id and text all count in group_size and share the verdict of their id; a null id never stays beside
    a non-null one (a group of null ids only has keep_id null and kept true).  Other columns of ``docs`` are
    ignored, whatever their names.  An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    digests = staged(base, "digests")
    n_cells = cells_for(digests.count(), bits_per_row, max_cells)

    bits = staged(seen_twice(digests, n_cells, probes), "bloom")  # at most max_cells / 8 bytes, hence the broadcast

    probe = digests
    for k, cell in enumerate(_cells(n_cells, probes)):
        probe = looked_up(probe, bits, cell, f"hit{k}")
    repeated = " and ".join(f"hit{k}" for k in range(probes))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]

    unique = (probe.filter(f"not ({repeated})")
              .select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                      F.lit(True).alias("kept"), "text_sha256"))
    maybe = probe.filter(repeated).select("doc_id", "text_sha256")
    groups = staged(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")),
                    "groups")  # written, so that AQE can split a skewed join with it
    verdict = (maybe.join(groups, "text_sha256")
               .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*columns))
    return unique.select(*columns).unionByName(verdict)
