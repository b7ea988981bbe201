"""Independent tables written at the same time: a job group and a fair pool each, rows counted by the writes themselves."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import TypeVar
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def run_together(spark: SparkSession, jobs: dict[str, Callable[[], T]], at_once: int = 8) -> dict[str, T]:
    """Results of all jobs by name; at most ``at_once`` plan and run at a time.

    A job's stages carry its name as job group and run in a pool of that name (shares are fair where the session was started with
    spark.scheduler.mode FAIR).  The first failure cancels the groups of the others and is raised.
    """
    if not jobs:
        return {}
    context, run = spark.sparkContext, uuid4().hex[:8]

    def one(name: str, job: Callable[[], T]) -> T:
        context.setJobGroup(f"{run}-{name}", name, interruptOnCancel=False)
        context.setLocalProperty("spark.scheduler.pool", name)
        return job()

    with ThreadPoolExecutor(max(1, min(at_once, len(jobs)))) as pool:
        futures = {pool.submit(one, name, job): name for name, job in jobs.items()}
        done, rest = wait(futures, return_when=FIRST_EXCEPTION)
        failed = next((f for f in done if not f.cancelled() and f.exception()), None)
        if failed:
            for f in rest:
                f.cancel()
                context.cancelJobGroup(f"{run}-{futures[f]}")
            raise failed.exception()
    return {name: f.result() for f, name in futures.items()}


def counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write ``df`` and return its rows, counted on their way: nothing is read again."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]
