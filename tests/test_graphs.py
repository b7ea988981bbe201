"""Components and the drawing without cycles against plain walks."""

import random

import pytest

from millrace.operators.graphs import EDGE, acyclic_edges, strong_components


def reach(pairs, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def plain_components(pairs):
    nodes = {x for p in pairs for x in p}
    to = {x: reach(pairs, x) for x in nodes}
    group = {x: {y for y in nodes if y == x or y in to[x] and x in to[y]} for x in nodes}
    return {x: min(g) for x, g in group.items() if len(g) > 1}


def plain_drawing(rows):
    kept = []
    for a, b, n in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a != b and a not in reach([k[:2] for k in kept], b):
            kept.append((a, b, n))
    return sorted(kept)


def graph(seed, nodes, edges):
    rng = random.Random(seed)
    names = [chr(97 + k) for k in range(nodes)]
    return [(a, b, rng.randint(1, 9)) for a, b in {(rng.choice(names), rng.choice(names)) for _ in range(edges)}]


@pytest.mark.parametrize("rows", [graph(1, 6, 14), graph(2, 12, 18), [("a", "a", 3)], [("a", "b", 1), ("b", "a", 1), ("b", "c", 5), ("c", "d", 1), ("d", "c", 1), ("d", "e", 2), ("e", "f", 7)]])
def test_components(spark, rows):
    edges = spark.createDataFrame([(a, b) for a, b, _ in rows], "src string, dst string")
    assert {r.node: r.component for r in strong_components(edges).collect()} == plain_components([(a, b) for a, b, _ in rows if a != b])


@pytest.mark.parametrize("seed,nodes,edges", [(3, 5, 20), (4, 9, 30), (5, 14, 26)])
def test_drawing_at_any_partitioning(spark, seed, nodes, edges):
    rows = graph(seed, nodes, edges)
    for parts in (1, 6):
        got = acyclic_edges(spark.createDataFrame(rows, EDGE).repartition(parts))
        assert sorted(map(tuple, got.collect())) == plain_drawing(rows)


def test_odd_graphs(spark):
    assert acyclic_edges(spark.createDataFrame([], EDGE)).collect() == []
    rows = [("a", "a", 9), (None, "a", 4), ("a", None, 4), ("b", "a", 2)]
    assert [tuple(r) for r in acyclic_edges(spark.createDataFrame(rows, EDGE)).collect()] == [("b", "a", 2)]
