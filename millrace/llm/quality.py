"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network with calibrated probabilities.

Random indexing: a word (a run of letters, of digits or of punctuation, as written) falls into one of ``rows`` rows by hash.
Every row has an index vector, ``signs`` random signs at random places of ``width``; a row's context vector is the sum
of the index vectors of all neighbours within ``window`` words, over every document of the corpus.  The word vector is the
context vector at unit length followed by the index vector; a document is the mean of its words' vectors, of the
whole text.

The network (numpy, one hidden layer of tanh, cross-entropy with weight decay, Adam) is fitted on a bounded sample of labelled
rows.  A fifth of the sample, chosen by hash, is set aside first: on it the network of the others shows by what temperature its
logits must be divided; then the network is fitted on the whole sample and keeps that temperature.

Scale: context vectors are integer sums that each task collects in one table of ``rows`` x ``width`` and sends row by row;
they meet by row, so a shuffle holds at most a table a task, whatever the words' frequencies, and the result does not depend
on the partitioning.  The merged table (``rows`` x ``width``, 4 MiB by default) is what reaches driver and workers.  Scoring is row-local.

Nulls: a null text counts as empty; a text without words has the zero vector and the network's score of it.  Labels with a null id
or quality are left out; of repeated labels of an id the lowest counts; documents that repeat a labelled id are all candidates for
the sample.  Without labels of both kinds every score is the share of label 1 (0.5 without labels).  Other columns are ignored,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WordHashes, dropped, mixed, partitions, staged, text_or_empty

WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Words whose neighbour sums are added to the table at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Vectors:
    """Sizes of the random indexing."""

    rows: int = 1 << 14
    width: int = 64
    signs: int = 4
    window: int = 2

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of every row's index vector, from the row's number alone; two at one place add up."""
        seeds = np.arange(self.rows * self.signs, dtype=np.uint64).reshape(self.rows, self.signs)
        bits = mixed(seeds + np.uint64(0x51ED270B))
        return (bits % np.uint64(self.width)).astype(np.int64), np.where(bits >> np.uint64(63), 1, -1).astype(np.int64)


def row_ids(text: str, hashes: WordHashes, rows: int) -> np.ndarray:
    """The row of each word of a whole text."""
    return (hashes.of([w.encode() for w in WORD.findall(text)]) % np.uint64(rows)).astype(np.int64)


def add_contexts(table: np.ndarray, texts: list[np.ndarray], how: Vectors) -> None:
    """Add the index vectors of all neighbours in ``texts`` (rows of words) to ``table`` (int64, flat)."""
    at, sign = how.index()
    flat = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for gap in range(1, how.window + 1):
        near = owner[:-gap] == owner[gap:]
        left, right = flat[:-gap][near], flat[gap:][near]
        for word, neighbour in ((left, right), (right, left)):
            for k in range(how.signs):
                # sums of signs: whole numbers, exact as doubles
                table += np.bincount(word * how.width + at[neighbour, k], sign[neighbour, k], minlength=len(table)).astype(np.int64)


def _contexts(how: Vectors):
    """Collect this task's table and send the rows in which something stands."""
    def collect(batches):
        table, hashes, texts, held = np.zeros(how.rows * how.width, np.int64), WordHashes(), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts.append(row_ids(text, hashes, how.rows))
                held += len(texts[-1])
                if held >= CHUNK:
                    add_contexts(table, texts, how)
                    texts, held = [], 0
        if texts:
            add_contexts(table, texts, how)
        table = table.reshape(how.rows, how.width)
        for part in np.array_split(np.flatnonzero(table.any(axis=1)), 16):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([table[k].tobytes() for k in part], pa.binary())], names=["row", "sums"])

    return collect


def _merged(batches):
    """Streams tables' rows ordered by row; the sum of each."""
    at, total = None, None
    for batch in batches:
        done = []
        for row, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if row != at:
                if at is not None:
                    done.append((at, total.tobytes()))
                at, total = row, np.zeros(len(sums) // 8, np.int64)
            total = total + np.frombuffer(sums, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([s for _, s in done], pa.binary())], names=["row", "sums"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["row", "sums"])


def context_sums(docs: DataFrame, how: Vectors, text_col: str = "text") -> DataFrame:
    """row and sums (int64 bytes) of every row of which a word has a neighbour in ``docs``: ``rows`` rows at most."""
    parts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_contexts(how), "row long, sums binary")
    return parts.repartition(partitions(docs.sparkSession), "row").sortWithinPartitions("row").mapInArrow(_merged, "row long, sums binary")


def word_vectors(docs: DataFrame, how: Vectors = Vectors(), text_col: str = "text") -> np.ndarray:
    """The table of word vectors: ``rows`` x 2 ``width``."""
    table = np.zeros((how.rows, how.width), np.float32)
    for r in context_sums(docs, how, text_col).collect():  # at most ``rows`` rows of ``width`` numbers
        sums = np.frombuffer(r.sums, np.int64).astype(np.float64)
        table[r.row] = sums / max(np.linalg.norm(sums), 1e-12)
    at, sign = how.index()
    own = np.zeros((how.rows, how.width), np.float32)
    np.add.at(own, (np.arange(how.rows)[:, None], at), sign / np.sqrt(how.signs))
    return np.concatenate([table, own], axis=1)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean of the vectors of a text's words; zero without words."""
    if not len(ids):
        return np.zeros(vectors.shape[1])
    rows, times = np.unique(ids, return_counts=True)
    return times.astype(np.float64) @ vectors[rows].astype(np.float64) / len(ids)


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, float)))


@dataclass
class Network:
    """Standardised inputs, a hidden layer of tanh, one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    @staticmethod
    def constant(inputs: int, share: float) -> Network:
        return Network(np.zeros(inputs), np.ones(inputs), np.zeros((inputs, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, units: int = 32, decay: float = 1e-3, steps: int = 400, rate: float = 0.02, seed: int = 7) -> Network:
    """Weights by Adam on the whole sample's gradient; the same for the same rows."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, n = (x - mean) / scale, len(y)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], units)), np.zeros(units), rng.normal(0, units ** -0.5, units), np.log(share / (1 - share))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = (sigmoid(h @ p[2] + p[3]) - y) / n
        back = np.outer(error, p[2]) * (1 - h * h)
        gradient = [z.T @ back + decay * p[0], back.sum(axis=0), h.T @ error + decay * p[2], error.sum()]
        for k, g in enumerate(gradient):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Network(mean, scale, p[0], p[1], p[2], float(p[3]))


def loss(logits: np.ndarray, y: np.ndarray, temperature: float) -> float:
    """Mean cross-entropy at a temperature."""
    s = logits / temperature
    return float(np.mean(np.logaddexp(0.0, s) - y * s))


def calibrated_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss between 1/20 and 20, by golden section on its logarithm (the loss is convex in its inverse)."""
    if not len(y) or len(np.unique(y)) < 2:
        return 1.0
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(logits, y, np.exp(a)) <= loss(logits, y, np.exp(b)):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


@dataclass
class QualityModel:
    how: Vectors
    vectors: np.ndarray
    network: Network

    def of(self, text: str, hashes: WordHashes) -> np.ndarray:
        return pooled(row_ids(text, hashes, self.how.rows), self.vectors)


def _sample_vectors(how: Vectors, shared):
    def pool(batches):
        hashes, vectors = WordHashes(), shared.value
        for batch in batches:
            means = [pooled(row_ids(t, hashes, how.rows), vectors) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([m.tobytes() for m in means], pa.binary())], names=["digest", "y", "calibrates", "x"])

    return pool


def train(docs: DataFrame, labels: DataFrame, how: Vectors = Vectors(), max_rows: int = 20_000, units: int = 32, decay: float = 1e-3,
          may_learn: Column | None = None) -> QualityModel:
    """Word vectors of all ``docs``; a network of at most ``max_rows`` labelled ones, the first by a hash of their id.

    ``may_learn``: of the labels (column doc_id), those that may be used.  Rows are ordered by digest before the fit, so the
    partitioning changes nothing.
    """
    vectors = word_vectors(docs, how)
    usable = labels.filter("doc_id is not null and quality is not null")
    usable = usable.filter(may_learn) if may_learn is not None else usable
    first = (usable.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(first), "doc_id")  # max_rows rows of two numbers
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text").cast("binary"))
    rows = texts.select(digest.alias("digest"), "y", (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0).alias("calibrates"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    vectored = staged(rows.mapInArrow(_sample_vectors(how, shared), "digest string, y int, calibrates boolean, x binary"), "quality-sample")
    sample = vectored.orderBy("digest").limit(max_rows).collect()  # repeated ids may exceed the bound before
    dropped(vectored)
    shared.unpersist()
    y = np.array([r.y for r in sample], float)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return QualityModel(how, vectors, Network.constant(vectors.shape[1], share))
    x = np.array([np.frombuffer(r.x) for r in sample])
    apart = np.array([r.calibrates for r in sample])
    learn = ~apart if len(np.unique(y[~apart])) == 2 else np.ones(len(y), bool)
    part = fit_network(x[learn], y[learn], units, decay)
    network = part if learn.all() else fit_network(x, y, units, decay)
    network.temperature = calibrated_temperature(part.logit(x[apart]), y[apart]) if apart.any() else 1.0
    return QualityModel(how, vectors, network)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row of ``docs``, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model, hashes = shared.value, WordHashes()
        for batch in batches:
            means = [model.of(t, hashes) for t in batch.column(1).to_pylist()]
            p = model.network.probability(np.array(means)) if means else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def brute_force_contexts(texts: list[str | None], how: Vectors) -> dict[int, np.ndarray]:
    """Context sums by the definition, word by word (for tests)."""
    at, sign = how.index()
    hashes, out = WordHashes(), {}
    for text in texts:
        rows = [int(hashes[w.encode()] % how.rows) for w in WORD.findall(text or "")]
        for i, row in enumerate(rows):
            for j in range(max(0, i - how.window), min(len(rows), i + how.window + 1)):
                if i != j:
                    sums = out.setdefault(row, np.zeros(how.width, np.int64))
                    for place, s in zip(at[rows[j]], sign[rows[j]]):
                        sums[place] += s
    return {k: v for k, v in out.items() if v.any()}
