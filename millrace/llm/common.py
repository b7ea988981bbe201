"""Helpers shared by the corpus operators: shared storage, word hashing, table access."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MASK = (1 << 64) - 1


#: Rows that Spark hands to a Python worker at once: texts are long, and the default of 10,000 rows is tens of megabytes a batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in the JVM and in the worker, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    """Null texts count as empty everywhere in this subpackage."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is ``spark.checkpoint.dir``; only where that is unset (single-machine tests) a temporary
    folder of this process takes its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_millrace_shared", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark._millrace_shared = path
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for parent in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/millrace/" in parent and os.path.basename(os.path.normpath(root)) in parent:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(parent)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def filesystem(uri: str):
    """The file system of a folder and the folder's path in it, for tasks that read and write files of the shared folder."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def write_bytes(folder: str, name: str, *data: bytes) -> None:
    """Write a file into the shared folder: temporary name first, then renamed, so a task that runs again does no harm."""
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    part = f"{base}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        for block in data:
            out.write(block)
    files.move(part, f"{base}/{name}")


def read_bytes(folder: str, name: str) -> bytes:
    files, base = filesystem(folder)
    with files.open_input_stream(f"{base}/{name}") as src:
        return src.read()


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions for a keyed exchange: the session's shuffle width."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


class WordHashes(dict):
    """64-bit hashes of words (bytes), memoised; ``bound`` keeps the memory of one worker constant."""

    def __init__(self, seed: int = 0, bound: int = 300_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) >= self.bound:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (published splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words_of(data: bytes) -> list[bytes]:
    """Lower-case A-Z, then words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text (bytes.lower and bytes.split do just that)."""
    return data.lower().split()


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` words; a shorter sequence counts as one shingle, an empty one has none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    take = min(n, width)
    out = np.full(n - take + 1, take, U64)
    for k in range(take):
        out = mixed(out ^ word_hashes[k : k + len(out)]) * U64(0x9E3779B97F4A7C15)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
