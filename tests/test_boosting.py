"""Histogram boosting against a plain one that grows a leaf at a time over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import boosting
from millrace.operators.boosting import UNIT, Boosting

NAMES = ["a", "b", "c"]


def table(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.randint(0, 6), rng.choice([None, *range(40)]), rng.randint(0, 300)
        p = 1 / (1 + math.exp(-(a - 3 + (2 if (b or 0) > 25 else -1) * (c > 120))))
        rows.append((k, a, b, c, int(rng.random() < p)))
    return rows, spark.createDataFrame(rows, "id long, a int, b int, c int, target int")


def plain_trees(rows, how, bounds, weight):
    """Rows in, leaves out: every row is looked at for every leaf and split."""
    codes = [[0 if v is None else sum(v > x for x in bounds[f]) for f, v in enumerate(r[1:4])] for r in rows]
    y = [r[4] for r in rows]
    share = sum(y) / len(y)
    margin, trees = [math.log(share / (1 - share))] * len(rows), []
    for _ in range(how.trees):
        g, h = [], []
        for k in range(len(rows)):
            p = 1.0 / (1.0 + float(np.exp(-margin[k])))
            w, t = (weight, p - 1) if y[k] else (1, p)
            g.append(int(np.rint(w * t * UNIT)))
            h.append(int(np.rint(w * (p * (1 - p)) * UNIT)) if y[k] else int(np.rint(p * (1 - p) * UNIT)))
        leaves, splits = {1: list(range(len(rows)))}, {}
        gain_of = lambda ks: (sum(g[k] for k in ks) / UNIT) ** 2 / (sum(h[k] for k in ks) / UNIT)

        def best(i):
            found = None
            if i.bit_length() > how.depth:
                return None
            for f in range(3):
                for cut in range(len(bounds[f])):
                    left, right = [k for k in leaves[i] if codes[k][f] <= cut], [k for k in leaves[i] if codes[k][f] > cut]
                    if min(len(left), len(right)) >= how.min_rows:
                        gain = gain_of(left) + gain_of(right) - gain_of(leaves[i])
                        if gain > 1e-9 and (found is None or gain > found[0]):
                            found = (gain, f, cut, left, right)
            return found

        candidates = {1: best(1)}
        while len(leaves) < how.leaves:
            open_ = [(-c[0], i) for i, c in candidates.items() if c]
            if not open_:
                break
            _, i = min(open_)
            _, f, cut, left, right = candidates.pop(i)
            splits[i] = (f, cut)
            del leaves[i]
            leaves[2 * i], leaves[2 * i + 1] = left, right
            candidates[2 * i], candidates[2 * i + 1] = best(2 * i), best(2 * i + 1)
        for i, ks in leaves.items():
            step = -how.step * (sum(g[k] for k in ks) / UNIT) / (sum(h[k] for k in ks) / UNIT)
            for k in ks:
                margin[k] += step
        trees.append(splits)
    return trees, margin


@pytest.mark.parametrize("groups", [25_000, 50])  # rounds within one task, and as jobs over several
@pytest.mark.parametrize("how", [Boosting(trees=4, leaves=6, depth=4, bins=12, rewrite=3), Boosting(trees=3, leaves=5, depth=20, bins=9, min_rows=40)])
def test_equals_plain_trees(spark, monkeypatch, how, groups):
    monkeypatch.setattr(boosting, "GROUPS", groups)
    rows, df = table(spark, 500)
    model = boosting.train(df, NAMES, how=how)
    n, p = len(rows), sum(r[4] for r in rows)
    assert model.weight == (n - p) / p
    trees, margin = plain_trees(rows, how, model.bounds, model.weight)
    assert [{i: (t.feature, t.bin) for i, t in tree.items() if t.feature >= 0} for tree in model.trees] == trees
    got = {r.id: r.margin for r in boosting.margins(df, model, "id").collect()}
    assert [got[k] for k in range(n)] == pytest.approx(margin)
    assert all(sum(t.feature < 0 for t in tree.values()) <= how.leaves for tree in model.trees)


def test_two_thousand_rows_and_any_partitioning(spark, monkeypatch):
    """The same model, to the last bit, however the rows lie."""
    how = Boosting(trees=5, leaves=31, depth=5, rewrite=2)
    rows, df = table(spark, 2000, 7)
    one = boosting.train(df.coalesce(1), NAMES, how=how)
    monkeypatch.setattr(boosting, "GROUPS", 400)
    for parts in (3, 11):
        other = boosting.train(df.repartition(parts, "c"), NAMES, how=how)
        assert other.trees == one.trees and all((a == b).all() for a, b in zip(one.bounds, other.bounds))
    margin = one.margin(np.array([[0 if v is None else np.searchsorted(one.bounds[f], v) for f, v in enumerate(r[1:4])] for r in rows], np.uint8))
    y = np.array([r[4] for r in rows])
    assert np.mean((margin > 0) == y) > 0.75


def test_sums_meet_before_the_driver(spark, monkeypatch):
    how = Boosting(trees=2, leaves=8, bins=16)
    _, df = table(spark, 600, 3)
    want = boosting.train(df, NAMES, how=how).trees
    monkeypatch.setattr(boosting, "FAN", 0)
    monkeypatch.setattr(boosting, "GROUPS", 50)
    assert boosting.train(df, NAMES, how=how).trees == want


def test_bins(spark):
    df = spark.createDataFrame([(k % 5, float(k), None) for k in range(1000)], "few int, many double, none int")
    few, many, none = boosting.bin_bounds(df, ["few", "many", "none"], 10)
    assert few.tolist() == [0, 1, 2, 3] and none.tolist() == [] and many.tolist() == [float(k) for k in range(99, 999, 100)]


def test_nodes_and_importances(spark):
    _, df = table(spark, 800, 5)
    model = boosting.train(df, [*NAMES, "id"], how=Boosting(trees=6, leaves=7))
    nodes = boosting.node_table(spark, model).persist()
    walk, gain = {f: 0 for f in model.features}, {f: 0.0 for f in model.features}
    for tree in model.trees:
        for node in tree.values():
            if node.feature >= 0:
                walk[model.features[node.feature]] += 1
                gain[model.features[node.feature]] += node.gain
    got = {r.feature: (r.splits, r.gain) for r in boosting.importances(nodes, model.features).collect()}
    assert {f: s for f, (s, _) in got.items()} == walk and all(got[f][1] == pytest.approx(gain[f]) for f in gain)
    # the same by SQL over the table: every split has two children, whose rows are its own
    duckdb = pytest.importorskip("duckdb")
    nodes_pd = nodes.toPandas()  # noqa: F841
    assert duckdb.sql("""select count(*) from nodes_pd p join nodes_pd l on l.tree = p.tree and l.node = p."left" join nodes_pd r on r.tree = p.tree
                         and r.node = p."right" where p.feature is not null and p.cover = l.cover + r.cover""").fetchall()[0][0] == sum(walk.values())
    sql = duckdb.sql("select feature, count(*), sum(gain) from nodes_pd where feature is not null group by feature").fetchall()
    assert {f: n for f, n, _ in sql} == {f: n for f, n in walk.items() if n}


def test_saved_model_scores_as_before(spark, tmp_path):
    _, df = table(spark, 400, 9)
    model = boosting.train(df, NAMES, how=Boosting(trees=3))
    boosting.save(spark, model, str(tmp_path / "m"))
    boosting.save(spark, model, str(tmp_path / "m"))  # again over the old one
    again = boosting.load(spark, str(tmp_path / "m"))
    key = lambda m: sorted((r.id, round(r.margin, 12)) for r in boosting.margins(df, m, "id").collect())
    assert key(again) == key(model) and again.features == model.features


def test_degenerate_targets(spark):
    _, df = table(spark, 60)
    for other in (df.limit(0), df.withColumn("target", F.lit(1)), df.withColumn("target", F.lit(None).cast("int")), df.withColumn("target", F.lit(0))):
        model = boosting.train(other, NAMES)
        assert model.trees == [] and boosting.margins(df, model, "id").filter("margin is null").count() == 0
    flat = boosting.train(df.withColumns({f: F.lit(1) for f in NAMES}), NAMES, how=Boosting(trees=3))
    assert flat.trees == []
    with pytest.raises(ValueError):
        Boosting(depth=0)
