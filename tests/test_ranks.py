"""Global ranks: equal to a sort, no task over its share."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.ranks import global_rank, top_ranked
from millrace.sources.tables import scratch


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_ranks_equal_a_sort(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, 1.0, 2.0, 2.5]), rng.choice("ab"), k) for k in range(300)]  # a third of all rows are ties
    df = spark.createDataFrame(rows, "v double, a string, k long").repartition(5)
    got = {r.k: r["rank"] for r in global_rank(df, [F.desc_nulls_last("v"), F.asc("a"), F.asc("k")], parts=parts).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))
    assert got == {r[2]: n for n, r in enumerate(want, 1)}


def test_ranks_of_nothing_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "v long, _n string")
    assert global_rank(empty, [F.asc("v")]).collect() == []
    same = spark.createDataFrame([(1,)] * 50, "v long")
    assert sorted(r["place"] for r in global_rank(same, [F.asc("v")], "place", 4).collect()) == list(range(1, 51))


def test_ties_spread_over_the_ranges(spark):
    """A hot first key does not put its rows into one range: the other order columns part it."""
    df = spark.range(20_000).select(F.lit(7).alias("v"), "id")
    dealt = df.repartitionByRange(8, F.asc("v"), F.asc("id")).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 2 * 20_000 / 8
    got = global_rank(df, [F.asc("v"), F.asc("id")], parts=8)
    assert got.filter("rank <> id + 1").count() == 0


def test_top_ranked(spark):
    got = top_ranked(spark.range(100), [F.desc("id")], 3).collect()
    assert [(r.id, r["rank"]) for r in got] == [(99, 1), (98, 2), (97, 3)]


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(ValueError):
        scratch(Cluster())
    assert scratch(spark) == scratch(spark)
