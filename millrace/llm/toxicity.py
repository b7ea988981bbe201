"""Toxicity: cumulative-link (proportional-odds) ordinal regression over sparse word features.

Severity grades come from ``labels``: 0 fair text, 1 poor text without toxicity, 2 toxic text.
Features are words and their beginnings (3 to 8 letters), each at the levels "occurs once, twice, three times at least".
One weight vector serves all grades; ordered thresholds separate them: P(grade <= k) = sigmoid(theta_k - w.x).
Features are picked for each threshold: those commoner above it than below.
The result is the expected severity, and a document is rejected when P(grade >= 2) reaches ``reject_at``.

Scale: the fit uses a bounded sample of labelled rows (``max_rows``); feature statistics for selection are
aggregated in Spark and at most ``max_features`` features reach the driver.  Scoring is row-local with the
small model in the task closure: no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, staged, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
GRADES = 3


#: Letters of a beginning, and counts from which a feature holds.
BEGINNINGS, LEVELS = range(3, 9), (1, 2, 3)


def features(text: str) -> list[str]:
    """Names of the features that hold: level, then the word or ``^`` and its beginning."""
    counts = Counter(WORD.findall(text.lower()))
    for word, k in list(counts.items()):
        for n in BEGINNINGS:
            if len(word) > n:
                counts["^" + word[:n]] += k
    return [f"{q}{name}" for name, k in counts.items() for q in LEVELS if k >= q]


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, float)))


@dataclass
class OrdinalModel:
    """Weights by feature, thresholds theta_0 <= theta_1 <= ... between grades."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (math.inf,) * (GRADES - 1)

    def __post_init__(self):
        # what a word or beginning adds by its count, and the first letters of all of them
        self.gains: dict[str, list[float]] = {}
        for name, w in self.weights.items():
            gain = self.gains.setdefault(name[1:], [0.0] * len(LEVELS))
            for k in range(int(name[0]) - 1, len(LEVELS)):
                gain[k] += w
        self.heads = {name.lstrip("^")[:BEGINNINGS[0]] for name in self.gains}

    def margin(self, text: str) -> float:
        counts: Counter = Counter()
        for word, k in Counter(WORD.findall(text.lower())).items():
            if word[:BEGINNINGS[0]] in self.heads:
                if word in self.gains:
                    counts[word] += k
                for n in BEGINNINGS:
                    if len(word) > n and (start := "^" + word[:n]) in self.gains:
                        counts[start] += k
        return sum(self.gains[name][min(k, len(LEVELS)) - 1] for name, k in sorted(counts.items()))

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. as columns."""
        return np.stack([1.0 - sigmoid(t - margin) for t in self.thresholds], axis=-1)


def fit(rows: list[list[int]], grades: np.ndarray, n_features: int, grade_count: int = GRADES, l2: float = 1.0,
        steps: int = 600, rate: float = 0.1, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Maximum a-posteriori weights and thresholds by Adam on the exact gradient.

    rows: feature ids of each example.  Ends after ``steps``, or once 25 of them improve the loss by less than ``tolerance``
    of itself.  Without an example the thresholds are infinite (grade 0 for all).
    """
    n = len(rows)
    if n == 0:
        return np.zeros(n_features), np.full(grade_count - 1, np.inf)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    feature = np.fromiter((f for r in rows for f in r), np.int64, len(owner))
    share = np.array([(np.sum(grades <= k) + 0.5) / (n + 0.5 * grade_count) for k in range(grade_count - 1)])
    start = np.log(share / (1 - share))
    # parameters: weights, first threshold, logs of the gaps to the next ones
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate([np.zeros(n_features), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)

    def theta(p):
        return np.cumsum(np.concatenate([p[n_features:n_features + 1], np.exp(p[n_features + 1:])]))

    last = np.inf
    for step in range(1, steps + 1):
        th = np.concatenate([[-np.inf], theta(p), [np.inf]])
        score = np.bincount(owner, p[feature], minlength=n)
        hi, lo = sigmoid(th[grades + 1] - score), sigmoid(th[grades] - score)
        prob = np.maximum(hi - lo, 1e-12)
        if step % 25 == 0:
            loss = -np.log(prob).sum() + 0.5 * l2 * (p[:n_features] @ p[:n_features])
            if last - loss < tolerance * loss:
                break
            last = loss
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob  # of log prob by its two thresholds
        g_score = -(d_hi - d_lo)
        g = np.zeros_like(p)
        g[:n_features] = np.bincount(feature, g_score[owner], minlength=n_features) - l2 * p[:n_features]
        g_th = np.zeros(grade_count + 1)
        np.add.at(g_th, grades + 1, d_hi)
        np.add.at(g_th, grades, -d_lo)
        g_th = g_th[1:-1]
        g[n_features] = g_th.sum()
        for k in range(grade_count - 2):
            g[n_features + 1 + k] = g_th[k + 1:].sum() * np.exp(p[n_features + 1 + k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:n_features], theta(p)


def _feature_sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([features(t) for t in batch.column(3).to_pylist()], pa.list_(pa.string()))],
            names=["doc_id", "grade", "digest", "features"])


def _gain(c, a, n: float, t: float):
    """Likelihood-ratio statistic of a feature in ``c`` of ``n`` texts, ``a`` of them among the ``t`` above a threshold."""
    def term(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))

    return 2 * (term(a, c * (t / n)) + term(c - a, c * (1 - t / n) + 1e-9)
                + term(F.lit(t) - a, (n - c) * (t / n) + 1e-9) + term((n - c) - (t - a), (n - c) * (1 - t / n) + 1e-9))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_features: int = 2000,
          min_gain: float = 24.0, l2: float = 0.2) -> OrdinalModel:
    """Fit on at most ``max_rows`` labelled documents, taken in order of a hash of their id.

    Features of a threshold are those that are commoner above it with a likelihood-ratio statistic of ``min_gain`` or more,
    the strongest ``max_features`` of them.  Documents that repeat a labelled id all count in these statistics; at most ``max_rows``
    rows, by id and text, reach the driver.  Labels with null doc_id or null toxic are left out; null quality counts as
    fair; repeated labels of a document count once, the most severe one.  Without toxic labels nothing is toxic.
    """
    grade = F.when(F.col("toxic") > 0, 2).when(F.coalesce(F.col("quality"), F.lit(1)) <= 0, 1).otherwise(0)
    chosen = (labels.filter("doc_id is not null and toxic is not null")
              .groupBy("doc_id").agg(F.max(grade).alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    sample = (texts.join(F.broadcast(chosen), "doc_id")  # max_rows rows of two numbers
              .select("doc_id", "grade", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
              .mapInArrow(_feature_sets, "doc_id long, grade int, digest string, features array<string>"))
    sample = staged(sample, "toxicity-sample")
    over = range(1, GRADES)  # thresholds: the grades from which they ask
    above = [F.sum(F.expr(f"double(grade >= {k})")).alias(f"a{k}") for k in over]
    total = sample.agg(F.count("*").cast("double").alias("n"), *above).first()
    if not total.n or not total[f"a{GRADES - 1}"]:
        dropped(sample)
        return OrdinalModel()
    counts = staged(sample.select("grade", F.explode("features").alias("name")).groupBy("name")
                    .agg(F.count("*").cast("double").alias("c"), *above).filter("c >= 3"), "toxicity-counts")
    names: set[str] = set()
    for k in over:
        n, t, c, a = total.n, total[f"a{k}"], F.col("c"), F.col(f"a{k}")
        strength = counts.filter(a * n > c * t).select("name", _gain(c, a, n, t).alias("gain"))
        names |= {r.name for r in strength.filter(F.col("gain") >= min_gain).orderBy(F.desc("gain"), "name").limit(max_features).collect()}
    dropped(counts)
    vocabulary = {name: k for k, name in enumerate(sorted(names))}
    known = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    # documents may repeat an id: the bound is one of rows, and their order is that of ids and texts
    few = sample.select("doc_id", "digest", "grade", F.array_intersect("features", known).alias("names"))
    rows = few.orderBy("doc_id", "digest").limit(max_rows).select("grade", "names").collect()
    dropped(sample)
    w, theta = fit([[vocabulary[x] for x in r.names] for r in rows], np.array([r.grade for r in rows]), len(vocabulary), l2=l2)
    return OrdinalModel({name: float(w[k]) for name, k in vocabulary.items()}, tuple(float(x) for x in theta))


SCORED = "expected_severity double, p_toxic double, rejected boolean"


def brute_force(text: str | None, model: OrdinalModel) -> tuple[float, float]:
    """Expected severity and P(toxic) by the definition: every feature of the text looked up by its name (for tests)."""
    x = sum(model.weights.get(name, 0.0) for name in features(text or ""))
    at_least = [1.0 / (1.0 + math.exp(min(t - x, 700.0))) for t in model.thresholds]
    return sum(at_least), at_least[-1]


def score_toxicity(docs: DataFrame, model: OrdinalModel, reject_at: float = 0.5, text_col: str = "text",
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row, then expected_severity, p_toxic and rejected.

    Whole texts; null counts as empty (margin 0).  Repeated rows give repeated results.
    """
    inner = [f"c{k}" for k in range(len(keep))]
    own = [] if text_col in keep else [text_or_empty(text_col).alias("t")]  # a kept text is not sent twice
    src = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, inner)], *own)
    types = ", ".join(f"{a} {docs.schema[c].dataType.simpleString()}" for c, a in zip(keep, inner))
    at = keep.index(text_col) if text_col in keep else len(keep)

    def score(batches):
        for batch in batches:
            margin = np.array([model.margin(t or "") for t in batch.column(at).to_pylist()], float)
            p = model.at_least(margin)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(inner)], pa.array(p.sum(axis=1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= reject_at)],
                names=[*inner, "expected_severity", "p_toxic", "rejected"])

    out = src.mapInArrow(score, f"{types}, {SCORED}")
    for c, a in zip(keep, inner):
        out = out.withColumnRenamed(a, c)
    return out
