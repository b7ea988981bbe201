"""Connected components by alternating large-star and small-star steps (a distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, staged


def _summary(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    Self links and repeated links change nothing; null ends are left out.  Each round groups by node with
    partial aggregation and joins back (a node with very many links is a skewed join, which AQE splits); links
    never reach the driver, rounds are cut by tables in the shared folder, their number grows with the logarithm of
    the longest path.
    """
    ends = edges.filter("a is not null and b is not null and a <> b")
    now = staged(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _summary(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = staged(both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .unionByName(low.filter("m < a").select("a", F.col("m").alias("b"))).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = staged(small, "links")
        dropped(large)
        before, state = state, _summary(after)
        dropped(now)
        now = after
        if state == before:
            break
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
