"""Graphs as tables: strongly connected components, and the greedy drawing without cycles."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.sources.tables import forget, written

EDGE = "from_activity string, to_activity string, transition_count long"


def _step(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` (with a flag ``changed``) as a table without it, and how many rows changed, counted while writing."""
    seen = Observation()
    out = written(df.observe(seen, F.count_if("changed").alias("n")).drop("changed"), name)
    return out, seen.get["n"]


def _fixpoint(state: DataFrame, step, name: str) -> DataFrame:
    """Apply ``step`` until no row changes; every state is a table, so lineage does not grow and lost executors cost one step."""
    while True:
        following, changed = _step(step(state), name)
        forget(state)
        state = following
        if not changed:
            return state


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes that lie on a cycle of ``edges`` (src, dst); self loops count for nothing.

    Rounds of reachability over tables: every node learns the smallest node that reaches it (forward), and of the nodes that share
    it those that reach it in turn (backward) are its component; they leave, the others go on.  As many steps as the longest
    shortest path of a round; joins and aggregates only, nothing on the driver but the number of changes.
    """
    spark = edges.sparkSession
    live = written(edges.filter("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "graph-edges")
    found = spark.createDataFrame([], f"node {edges.schema['src'].dataType.simpleString()}, component {edges.schema['src'].dataType.simpleString()}")
    while True:
        # a node on a cycle is entered and left
        nodes = live.select(F.col("dst").alias("node")).intersect(live.select("src"))
        state = written(nodes.select("node", F.col("node").alias("low")), "graph-forward")
        if state.isEmpty():
            break

        def forward(s: DataFrame, live: DataFrame = live) -> DataFrame:
            least = live.join(s.select(F.col("node").alias("src"), "low"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("low").alias("_in"))
            return s.join(least, "node", "left").select("node", F.least("low", "_in").alias("low"), (F.coalesce("_in", "low") < F.col("low")).alias("changed"))

        def backward(s: DataFrame, live: DataFrame = live) -> DataFrame:
            ahead = s.filter("back").select(F.col("node").alias("dst"), "low")
            reached = live.join(ahead, "dst").select(F.col("src").alias("node"), "low").distinct().withColumn("_r", F.lit(True))
            return s.join(reached, ["node", "low"], "left").select(
                "node", "low", (F.col("back") | F.coalesce("_r", F.lit(False))).alias("back"), (~F.col("back") & F.coalesce("_r", F.lit(False))).alias("changed"))

        low = _fixpoint(state, forward, "graph-forward")
        marked = written(low.withColumn("back", F.col("node") == F.col("low")), "graph-backward")
        both = _fixpoint(marked, backward, "graph-backward")
        # a root that reaches itself in no other node is a component of one: no cycle
        done = both.filter("back").select("node", F.col("low").alias("component"))
        found = found.unionByName(done)
        gone = done.select(F.col("node"))
        left = live.join(gone, live.src == gone.node, "left_anti").join(gone, live.dst == gone.node, "left_anti")
        live = written(left, "graph-edges")
    sizes = found.groupBy("component").agg(F.count("*").alias("_n")).filter("_n > 1")
    return found.join(sizes, "component").select("node", "component")


def greedy(edges: pd.DataFrame) -> pd.DataFrame:
    """Of one component's edges, by count, those that close no cycle with the ones before.

    A topological order of the kept edges is maintained: an edge that agrees with it is kept at once, one against it is
    looked at between the two places only, and nodes there change places where it is kept.
    """
    rows = edges.sort_values(["transition_count", "from_activity", "to_activity"], ascending=[False, True, True], kind="stable")
    after, before = defaultdict(set), defaultdict(set)
    place = {x: k for k, x in enumerate(sorted({*rows["from_activity"], *rows["to_activity"]}))}
    kept = []

    def within(start: str, near: dict, fits) -> set | None:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen and fits(place[x]):
                    seen.add(x)
                    todo.append(x)
        return seen

    for a, b in zip(rows["from_activity"], rows["to_activity"]):
        if place[b] < place[a]:
            ahead = within(b, after, lambda k, top=place[a]: k <= top)
            if a in ahead:
                kept.append(False)
                continue
            behind = within(a, before, lambda k, bottom=place[b]: k >= bottom)
            order = sorted(behind, key=place.get) + sorted(ahead, key=place.get)
            for x, k in zip(order, sorted(place[x] for x in order)):
                place[x] = k
        after[a].add(b)
        before[b].add(a)
        kept.append(True)
    return rows[kept][["from_activity", "to_activity", "transition_count"]]


def acyclic_edges(graph: DataFrame) -> DataFrame:
    """Greedy reduction to a drawing without cycles: edges by count, ties by names; those that close a cycle or a self loop are skipped.

    Only an edge within a strongly connected component can close a cycle, so all others are kept as they are, and every component's
    edges (pairs of its activities) go through the greedy order in a task of their own.  Edges with a null end are left out.
    """
    edges = written(graph.select("from_activity", "to_activity", F.col("transition_count").cast("long").alias("transition_count"))
                    .filter("from_activity is not null and to_activity is not null and from_activity <> to_activity"), "graph-drawn")
    part = written(strong_components(edges.select(F.col("from_activity").alias("src"), F.col("to_activity").alias("dst"))), "graph-components")
    ends = (edges.join(part.select(F.col("node").alias("from_activity"), F.col("component").alias("_a")), "from_activity", "left")
            .join(part.select(F.col("node").alias("to_activity"), F.col("component").alias("_b")), "to_activity", "left"))
    inside = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    columns = ["from_activity", "to_activity", "transition_count"]
    within = ends.filter(inside).groupBy("_a").applyInPandas(greedy, EDGE)
    return ends.filter(~inside).select(*columns).unionByName(within)
