"""Histogram boosting of trees that grow best leaf first, for a binary target.

Features are cut into bins once; rows of equal bins are one row with its counts.  A tree grows by rounds: one job sums gradient,
hessian and rows by (leaf, feature, bin) over all rows, for every leaf that the queue may split next, and the queue (largest gain
first) is played on the driver until it asks for a leaf that is not known yet.  So the tree is the one that grows a leaf at a
time, but a round serves a whole front of leaves; a sibling's sums are its parent's less the other's.

Where all groups of equal rows fit into one task, its rounds run within that task, one after the other, instead of as jobs from the
driver: the same functions on the same sums, hence the same trees.

Gradients are whole numbers (2^-24 of a unit), so sums are exact and the model does not depend on the partitioning.  The driver holds
one histogram a leaf (bins x 3 numbers) and the trees, never rows; scores so far are written with the rows every ``rewrite`` trees, which
bounds both the work of a round and the lineage.

Nulls: a null feature counts as smaller than all values; rows with a null target are left out.  Without rows of both kinds the
model is its constant.  Ties of gain: the first feature, then the smallest bin, then the leaf nearer to the root, then the left one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.expr import cumulative_counts
from millrace.sources.tables import forget, written

#: Gradients count in units of 2^-24.
UNIT = float(1 << 24)
#: Groups of equal rows to a task, and tasks whose sums the driver adds itself; more meet in an exchange first.
GROUPS, FAN = 25_000, 32
NODES = ("tree int, node long, parent long, depth int, feature string, bin int, threshold double, gain double, cover long, hessian double, "
         "value double, left long, right long")


@dataclass(frozen=True)
class Boosting:
    """Size of the ensemble and of its trees, and what a split needs."""

    trees: int = 300
    leaves: int = 31
    depth: int = 5
    step: float = 0.05
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    bins: int = 255
    rewrite: int = 25

    def __post_init__(self):
        if not (1 <= self.depth <= 60 and 2 <= self.bins <= 256):
            raise ValueError("depth must be 1 to 60, bins 2 to 256")


@dataclass
class Node:
    """A leaf or a split (``feature`` 0 or more: rows of bins up to ``bin`` go left); ids as in a heap: children 2i and 2i+1."""

    id: int
    g: int
    h: int
    n: int
    value: float = 0.0
    feature: int = -1
    bin: int = -1
    gain: float = 0.0


Tree = dict[int, Node]


@dataclass
class Model:
    """Trees over binned features; ``bounds``: of every feature the largest value of each bin but the last, ascending."""

    features: list[str]
    bounds: list[np.ndarray]
    start: float
    weight: float = 1.0
    trees: list[Tree] = field(default_factory=list)

    def margin(self, codes: np.ndarray) -> np.ndarray:
        """Log-odds of rows of bin numbers."""
        return added(np.full(len(codes), self.start), codes, self.trees)


def leaves_of(codes: np.ndarray, tree: Tree) -> Iterator[tuple[int, np.ndarray]]:
    """The leaves that rows reach, with the places of their rows."""
    todo = [(1, np.arange(len(codes)))]
    while todo:
        i, rows = todo.pop()
        node = tree[i]
        if node.feature < 0:
            yield i, rows
        else:
            right = codes[rows, node.feature] > node.bin
            todo += [(2 * i + 1, rows[right]), (2 * i, rows[~right])]


def added(margin: np.ndarray, codes: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    margin = margin.copy()
    for tree in trees:
        for i, rows in leaves_of(codes, tree):
            margin[rows] += tree[i].value
    return margin


def gradients(margin: np.ndarray, weight: float) -> tuple[np.ndarray, ...]:
    """Gradient and hessian of the logistic loss in whole units: of a row with target 0, and of one with target 1 (times ``weight``)."""
    p = 1.0 / (1.0 + np.exp(-margin))
    unit = lambda x: np.rint(x * UNIT).astype(np.int64)
    return unit(p), unit(p * (1 - p)), unit(weight * (p - 1)), unit(weight * p * (1 - p))


def split_gains(sums: np.ndarray, node: Node, how: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every cut between the bins of one feature: the left side's sums, whether it may be taken, and its gain."""
    left = np.cumsum(sums, axis=0)[:-1]
    right = np.array([node.g, node.h, node.n]) - left
    fits = (left[:, 2] >= how.min_rows) & (right[:, 2] >= how.min_rows) & (np.minimum(left[:, 1], right[:, 1]) / UNIT >= how.min_hessian)
    return left, fits, score(left[:, 0], left[:, 1], how) + score(right[:, 0], right[:, 1], how) - score(node.g, node.h, how)


def best_split(sums: np.ndarray, offsets: np.ndarray, node: Node, how: Boosting) -> tuple[float, int, int, np.ndarray] | None:
    """Gain, feature, bin and the left side's sums of the best split of a leaf with histogram ``sums`` (bins x [g, h, n])."""
    best = None
    for f in range(len(offsets) - 1):
        left, fits, gain = split_gains(sums[offsets[f]:offsets[f + 1]], node, how)
        if fits.any():
            k = int(np.argmax(np.where(fits, gain, -np.inf)))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), f, k, left[k])
    return best


def score(g, h, how: Boosting):
    """What a leaf with these sums lowers the loss by, twice."""
    g, h = np.asarray(g, float) / UNIT, np.asarray(h, float) / UNIT
    return g * g / np.maximum(h + how.l2, 1e-12)


def value(node: Node, how: Boosting) -> float:
    return -how.step * (node.g / UNIT) / max(node.h / UNIT + how.l2, 1e-12)


def grown(histograms: Callable[[Tree, list[int]], list[np.ndarray]], offsets: np.ndarray, how: Boosting) -> Tree:
    """The tree that splits the leaf of the largest gain, again and again.

    histograms: those of the named leaves of a tree.  Leaves that may be split before long are asked for together.
    """
    known: Tree = {1: Node(1, 0, 0, 0)}  # every node that was ever opened
    sums: dict[int, np.ndarray] = {}
    splits: dict[int, tuple | None] = {}

    def deep(i: int) -> bool:
        return i.bit_length() > how.depth or known[i].n < 2 * how.min_rows

    def open_leaves(ids: list[int]) -> None:
        """Find the best split of leaves; of two siblings only the left one is summed."""
        asked = [i for i in ids if i % 2 == 0 or i - 1 not in ids]
        for i, found in zip(asked, histograms(known, asked)):
            sums[i] = found
        if ids == [1]:  # any feature's bins hold all rows
            known[1] = Node(1, *map(int, sums[1][:offsets[1]].sum(axis=0)))
        for i in ids:
            if i not in sums:
                sums[i] = sums[i // 2] - sums[i - 1]
            splits[i] = None if deep(i) else best_split(sums[i], offsets, known[i], how)
            if splits[i]:
                gain, f, k, left = splits[i]
                node = known[i]
                node.feature, node.bin, node.gain = f, k, gain
                known[2 * i] = Node(2 * i, *map(int, left))
                known[2 * i + 1] = Node(2 * i + 1, node.g - int(left[0]), node.h - int(left[1]), node.n - int(left[2]))

    open_leaves([1])
    while True:
        queue, leaves, taken, unknown = [(-splits[1][0], 1)] if splits[1] else [], 1, set(), []
        while queue and leaves < how.leaves and not unknown:
            _, i = heapq.heappop(queue)
            taken.add(i)
            leaves += 1
            for k in (2 * i, 2 * i + 1):
                if splits.get(k):
                    heapq.heappush(queue, (-splits[k][0], k))
                elif k not in splits and not deep(k):
                    unknown.append(k)
        if not unknown or leaves >= how.leaves:
            break
        # the other leaves in the queue will be split as well unless the leaves run out: open all their children in the same round
        for _, i in sorted(queue)[:how.leaves - leaves]:
            unknown += [k for k in (2 * i, 2 * i + 1) if k not in splits and not deep(k)]
        open_leaves(sorted(unknown))
    out: Tree = {}
    for i, node in known.items():
        if i in taken:
            out[i] = node
        elif i == 1 or i // 2 in taken:
            out[i] = Node(i, node.g, node.h, node.n, value(node, how))
    return out


def bin_bounds(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Of every feature the largest value of each bin but the last: a bin a value where there are few, else bins of about equal counts.

    Values are counted by (feature, value) and cumulated by ranges of values, so no task holds all values of a feature.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f).cast("double").alias("value")) for k, f in enumerate(features)])).alias("x"))
    cum = cumulative_counts(long.select("x.*").filter("value is not null"), ["feature"], "value")
    distinct = cum.groupBy("feature").agg(F.count("*").alias("_d"))  # a row a feature
    place = F.when(F.col("_d") <= bins, F.col("_v")).otherwise(F.floor((F.col("_hi") - F.col("_n")) * F.lit(bins) / F.col("_total")).cast("double"))
    tops = cum.join(F.broadcast(distinct), "feature").groupBy("feature", place.alias("_bin")).agg(F.max("_v").alias("top"))
    found: dict[int, list[float]] = {k: [] for k in range(len(features))}
    for r in tops.collect():  # at most ``bins`` rows a feature
        found[r.feature].append(r.top)
    return [np.array(sorted(v)[:-1]) for v in found.values()]


def binned(rows: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """codes (a byte a feature) of every row beside the kept columns (named c0, c1...)."""
    bounds, n, names = model.bounds, len(model.features), [f"c{k}" for k in range(len(keep))]
    kept = [c.alias(name) for name, c in zip(names, keep)]
    src = rows.select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(model.features)], *kept)

    def code(batches):
        for batch in batches:
            columns = []
            for k in range(n):
                x = batch.column(k).to_numpy(zero_copy_only=False)
                columns.append(np.where(np.isnan(x), 0, np.searchsorted(bounds[k], x, "left")).astype(np.uint8))
            codes = np.stack(columns, axis=1) if n else np.zeros((batch.num_rows, 0), np.uint8)
            flat = pa.Array.from_buffers(pa.binary(n), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([flat, *batch.columns[n:]], names=["codes", *names])

    types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema.fields[n:])
    return src.mapInArrow(code, "codes binary" + types)


def _blocks(start: float):
    """Rows of (codes, n, p) as columns of one row a batch: codes, counts and scores so far."""
    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                codes = b"".join(batch.column(0).to_pylist())
                n, p = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (codes, n.tobytes(), p.tobytes(), np.full(len(n), start).tobytes())],
                                                 names=["codes", "n", "p", "margin"])

    return pack


BLOCK = "codes binary, n binary, p binary, margin binary"


def _unpacked(batch, n_features: int):
    for codes, n, p, margin in zip(*[batch.column(k).to_pylist() for k in range(4)]):
        yield np.frombuffer(codes, np.uint8).reshape(-1, n_features), np.frombuffer(n, np.int64), np.frombuffer(p, np.int64), np.frombuffer(margin)


def _sums(codes, n, p, margin, trees, weight, tree: Tree, leaves: list[int], offsets) -> np.ndarray:
    """Histograms (leaf, bin, [g, h, n]) of a block's rows in the named leaves of ``tree``."""
    g0, h0, g1, h1 = gradients(added(margin, codes, trees), weight)
    columns = ((n - p) * g0 + p * g1, (n - p) * h0 + p * h1, n)
    slot, width = {i: k for k, i in enumerate(leaves)}, int(offsets[-1])
    out = np.zeros((len(leaves), width, 3), np.int64)
    for i, rows in leaves_of(codes, tree):
        if i in slot and len(rows):
            cells = (codes[rows] + offsets[:-1]).ravel()
            for k, x in enumerate(columns):
                high, low = (np.repeat(part, codes.shape[1]) for part in np.divmod(x[rows], 1 << 26))  # doubles hold whole numbers up to 2^53
                out[slot[i], :, k] = (np.bincount(cells, high, width).astype(np.int64) << 26) + np.bincount(cells, low, width).astype(np.int64)
    return out


def _round(n_features: int, trees: list[Tree], weight: float, tree: Tree, leaves: list[int], offsets: np.ndarray):
    def count(batches):
        total = None
        for batch in batches:
            for block in _unpacked(batch, n_features):
                found = _sums(*block, trees, weight, tree, leaves, offsets)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(leaves)), pa.int64()), pa.array([x.tobytes() for x in total], pa.binary())], names=["slot", "sums"])

    return count


def _meet(batches):
    """Sums by slot of rows ordered by slot."""
    at, total = None, None
    for batch in batches:
        for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if slot != at and at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])
            here = np.frombuffer(sums, np.int64)
            at, total = slot, here if slot != at else total + here
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])


class Rows:
    """The binned rows as blocks in the shared folder, with the scores of the trees so far."""

    def __init__(self, blocks: DataFrame, model: Model):
        self.n_features, self.weight = len(model.features), model.weight
        self.offsets = np.cumsum([0, *[len(b) + 1 for b in model.bounds]])  # of the features' bins
        self.fresh: list[Tree] = []  # trees that are not in the written scores
        self._keep(blocks)

    def _keep(self, blocks: DataFrame) -> None:
        self.table = written(blocks, "boosting")
        self.blocks = self.table.persist()  # read by every round; lost parts come from the written table
        self.tasks = self.blocks.rdd.getNumPartitions()

    def histograms(self, tree: Tree, leaves: list[int]) -> list[np.ndarray]:
        out = self.blocks.mapInArrow(_round(self.n_features, self.fresh, self.weight, tree, leaves, self.offsets), "slot long, sums binary")
        if self.tasks > FAN:
            out = out.repartition(len(leaves), "slot").sortWithinPartitions("slot").mapInArrow(_meet, "slot long, sums binary")
        total = [np.zeros((self.offsets[-1], 3), np.int64) for _ in leaves]
        for r in out.collect():  # leaves x FAN histograms at most
            total[r.slot] += np.frombuffer(r.sums, np.int64).reshape(-1, 3)
        return total

    def add(self, tree: Tree, rewrite: int) -> None:
        self.fresh.append(tree)
        if len(self.fresh) >= rewrite:
            trees, n = self.fresh, self.n_features

            def update(batches):
                for batch in batches:
                    margins = [added(m, c, trees).tobytes() for c, _, _, m in _unpacked(batch, n)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margins, pa.binary())], names=["codes", "n", "p", "margin"])

            old, self.fresh = self.table, []
            new = self.blocks.mapInArrow(update, BLOCK)
            before = self.blocks
            self._keep(new)
            before.unpersist()
            forget(old)

    def close(self) -> None:
        self.blocks.unpersist()
        forget(self.table)


GROWN = "tree int, node long, g long, h long, n long, value double, feature int, bin int, gain double"


def _in_one_task(n_features: int, weight: float, offsets: np.ndarray, how: Boosting):
    """All trees from the blocks of a single task; a row a node."""
    def grow(batches):
        blocks = [block for batch in batches for block in _unpacked(batch, n_features)]
        if not blocks:
            return
        codes, n, p, margin = (np.concatenate(parts) for parts in zip(*blocks))
        for t in range(how.trees):
            tree = grown(lambda tree, leaves: list(_sums(codes, n, p, margin, [], weight, tree, leaves, offsets)), offsets, how)  # noqa: B023
            if tree[1].feature < 0:
                return
            margin = added(margin, codes, [tree])
            columns = zip(*[(t, i, x.g, x.h, x.n, x.value, x.feature, x.bin, x.gain) for i, x in tree.items()])
            types = (pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, a) for c, a in zip(columns, types)], names=["tree", "node", "g", "h", "n", "value", "feature", "bin", "gain"])

    return grow


def prepared(rows: DataFrame, features: Sequence[str], target: str, weight: float | None, how: Boosting) -> tuple[Model, Rows | None]:
    """The model without a tree, and the binned rows; None where not both targets occur."""
    rows = rows.filter(F.col(target).isNotNull())
    one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(target).cast("long")), F.lit(0)).alias("p")).first()
    n, p = one.n, one.p
    weight = (n - p) / max(p, 1) if weight is None else weight
    share = min(max(p / n, 1e-6), 1 - 1e-6) if n else 0.5
    model = Model(list(features), bin_bounds(rows, features, how.bins), float(np.log(share / (1 - share))), weight)
    if not 0 < p < n:
        return model, None
    groups = binned(rows, model, F.col(target).cast("int")).groupBy("codes").agg(F.count("*").alias("n"), F.sum("c0").alias("p"))
    groups = written(groups, "boosting-groups")
    tasks = max(1, min(groups.rdd.getNumPartitions(), -(-groups.count() // GROUPS)))
    data = Rows(groups.coalesce(tasks).mapInArrow(_blocks(model.start), BLOCK), model)
    forget(groups)
    return model, data


def train(rows: DataFrame, features: Sequence[str], target: str = "target", weight: float | None = None, how: Boosting = Boosting()) -> Model:
    """A model of P(target = 1); rows of target 1 count ``weight`` times (None: as many as make both classes equal)."""
    model, data = prepared(rows, features, target, weight, how)
    if data is None:
        return model
    if data.tasks == 1:
        for r in data.blocks.mapInArrow(_in_one_task(len(features), model.weight, data.offsets, how), GROWN).collect():  # trees x twice the leaves
            if r.tree == len(model.trees):
                model.trees.append({})
            model.trees[r.tree][r.node] = Node(r.node, r.g, r.h, r.n, r.value, r.feature, r.bin, r.gain)
        data.close()
        return model
    while len(model.trees) < how.trees:
        tree = grown(data.histograms, data.offsets, how)
        if tree[1].feature < 0:  # no split left: later trees would be the same
            break
        model.trees.append(tree)
        data.add(tree, how.rewrite)
    data.close()
    return model


def root_splits(rows: DataFrame, features: Sequence[str], target: str = "target", weight: float | None = None, how: Boosting = Boosting()) -> DataFrame:
    """feature, threshold, rows_left and gain of every split that the first tree's root may take: at most ``bins`` a feature."""
    model, data = prepared(rows, features, target, weight, how)
    out = []
    if data is not None:
        sums = data.histograms({1: Node(1, 0, 0, 0)}, [1])[0]
        root = Node(1, *map(int, sums[:data.offsets[1]].sum(axis=0)))
        for f, name in enumerate(model.features):
            left, fits, gain = split_gains(sums[data.offsets[f]:data.offsets[f + 1]], root, how)
            out += [(name, float(model.bounds[f][k]), int(left[k, 2]), float(gain[k])) for k in np.flatnonzero(fits)]
        data.close()
    return rows.sparkSession.createDataFrame(out, "feature string, threshold double, rows_left long, gain double")


def margins(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns and ``margin`` (log-odds) of every row: row-local, trees in the task closure."""
    n = len(model.features)
    src = binned(rows, model, *[F.col(c) for c in keep])

    def score_rows(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, n) if batch.num_rows else np.zeros((0, n), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.margin(codes), pa.float64())], names=[*[f"c{k}" for k in range(len(keep))], "margin"])

    types = "".join(f"c{k} {rows.schema[c].dataType.simpleString()}, " for k, c in enumerate(keep))
    out = src.mapInArrow(score_rows, types + "margin double")
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(keep)})


def node_table(spark: SparkSession, model: Model) -> DataFrame:
    """Every node of every tree, at most twice the leaves a tree: splits with feature, threshold and gain, leaves with their value."""
    out = []
    for t, tree in enumerate(model.trees):
        for i, node in sorted(tree.items()):
            inner = node.feature >= 0
            bounds = model.bounds[node.feature] if inner else None
            out.append((t, i, i // 2 or None, i.bit_length() - 1, model.features[node.feature] if inner else None, node.bin if inner else None,
                        float(bounds[node.bin]) if inner else None, node.gain if inner else None, node.n, node.h / UNIT,
                        None if inner else node.value, 2 * i if inner else None, 2 * i + 1 if inner else None))
    return spark.createDataFrame(out, NODES)


def importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, splits (how often it divides a node) and gain (what these splits gain in all); zero for features that are never used."""
    every = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    used = nodes.filter("feature is not null").groupBy("feature").agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
    return every.join(used, "feature", "left").na.fill({"splits": 0, "gain": 0.0})


def save(spark: SparkSession, model: Model, path: str) -> None:
    """The model as two tables: nodes, and the features with their bins."""
    node_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    rows = [(k, f, [float(x) for x in b], model.start, model.weight) for k, (f, b) in enumerate(zip(model.features, model.bounds))]
    spark.createDataFrame(rows, "place int, feature string, bounds array<double>, start double, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load(spark: SparkSession, path: str) -> Model:
    """A model that was saved before; its nodes are as many as its trees have leaves."""
    rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()
    model = Model([r.feature for r in rows], [np.array(r.bounds) for r in rows], rows[0].start, rows[0].weight)
    place = {f: k for k, f in enumerate(model.features)}
    for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
        while len(model.trees) <= r.tree:
            model.trees.append({})
        model.trees[r.tree][r.node] = Node(r.node, 0, round(r.hessian * UNIT), r.cover, r.value or 0.0, place.get(r.feature, -1),
                                           -1 if r.bin is None else r.bin, r.gain or 0.0)
    return model
