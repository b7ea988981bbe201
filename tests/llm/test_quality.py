"""Quality classifier: contexts by the definition, held-out accuracy, calibration, odd rows."""

import numpy as np
import pytest
from corpus_cases import EDGES, SF, needs_tables, prose
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.common import WordHashes
from millrace.llm.quality import Vectors

LABELS = "doc_id long, quality int, text string"


@pytest.mark.parametrize("how", [Vectors(rows=64, width=16), Vectors(rows=1024, width=8, signs=2, window=3)])
@pytest.mark.parametrize("parts", [1, 4])
def test_contexts_equal_brute_force(spark, documents, how, parts):
    rows = [r for r in EDGES if r[0] != 7] + [(k, prose(k, k) + " ### $5 x_y!! 42\n") for k in range(8, 40)]
    got = {r.row: np.frombuffer(r.sums, np.int64) for r in quality.context_sums(documents(rows).repartition(parts), how).collect()}
    want = quality.brute_force_contexts([t for _, t in rows], how)
    assert {k for k, v in got.items() if v.any()} == set(want) and all((got[k] == want[k]).all() for k in want)


def test_chunks_change_nothing(monkeypatch):
    how, rng = Vectors(rows=32, width=8), np.random.default_rng(3)
    texts = [rng.integers(0, 32, rng.integers(0, 30)) for _ in range(50)]
    whole, parts = (np.zeros(32 * 8, np.int64) for _ in range(2))
    quality.add_contexts(whole, texts, how)
    for t in texts:
        quality.add_contexts(parts, [t], how)
    assert (whole == parts).all()


def junk(k):
    return " ".join(w + "###" if (j + k) % 3 else w.upper() + "!!" for j, w in enumerate(prose(k, 30).split()))


def test_learns_and_leaves_the_fold_alone(spark, documents):
    rows = [(k, prose(k, 30) if k % 3 else junk(k)) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), "clash") for k in range(600)] + [(None, 0, ""), (5, None, ""), (10_000, 1, "")], LABELS)
    model = quality.train(documents(rows), labels, Vectors(rows=1 << 12), may_learn=F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r.score for r in quality.score_quality(documents(rows), model).collect()}
    held = [k for k in got if k % 4 == 0]
    assert all(0 <= s <= 1 for s in got.values()) and np.mean([(got[k] > 0.5) == (k % 3 > 0) for k in held]) > 0.98
    # labels of the fold have no part in it
    wrong = labels.withColumn("quality", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.train(documents(rows).repartition(3), wrong, Vectors(rows=1 << 12), may_learn=F.col("doc_id") % 4 != 0)
    assert np.allclose(other.network.hidden, model.network.hidden) and other.network.temperature == pytest.approx(model.network.temperature)


def test_bound_holds_with_repeated_ids(spark, documents, monkeypatch):
    seen = []
    plain = quality.fit_network
    monkeypatch.setattr(quality, "fit_network", lambda x, y, *a: seen.append(len(y)) or plain(x, y, *a))
    rows = [(k % 50, prose(k, 12) if k % 2 else junk(k)) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, "") for k in range(50)] * 2, LABELS)
    quality.train(documents(rows), labels, Vectors(rows=256), max_rows=40)
    assert seen and seen[0] <= 40


def test_edges(spark, documents):
    none = quality.train(documents(EDGES), spark.createDataFrame([], LABELS), Vectors(rows=256))
    got = quality.score_quality(documents(EDGES), none).collect()
    assert len(got) == len(EDGES) and {r.score for r in got} == {0.5}
    one = quality.train(documents(EDGES), spark.createDataFrame([(4, 1, ""), (5, 1, "")], LABELS), Vectors(rows=256))
    assert {round(r.score, 9) for r in quality.score_quality(documents(EDGES), one).collect()} == {0.75}
    assert quality.score_quality(documents([]), one).collect() == []
    assert quality.train(documents([]), spark.createDataFrame([], LABELS), Vectors(rows=256)).vectors.shape == (256, 128)


def test_temperature():
    """Logits that are too sure by a factor are divided by it."""
    rng = np.random.default_rng(1)
    s = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < quality.sigmoid(s)).astype(float)
    assert quality.calibrated_temperature(3 * s, y) == pytest.approx(3, rel=0.1)
    assert quality.calibrated_temperature(s, np.ones(20_000)) == 1.0


def test_score_of_a_text_is_its_own(spark, documents):
    """Whole texts count: words at the end of a long text change its score."""
    rows = [(k, prose(k, 20) if k % 2 else junk(k)) for k in range(200)]
    model = quality.train(documents(rows), spark.createDataFrame([(k, k % 2, "") for k in range(200)], LABELS), Vectors(rows=1 << 12))
    long, ends = prose(1, 30_000), prose(1, 30_000) + " " + " ".join(junk(k) for k in range(4000))
    a, b = (float(model.network.probability(model.of(t, WordHashes()))) for t in (long, ends))
    assert a > 0.9 and b < a
    got = {r.doc_id: r.score for r in quality.score_quality(documents([(1, long), (2, ends)]), model).collect()}
    assert got == {1: pytest.approx(a), 2: pytest.approx(b)}


@needs_tables
def test_query_on_the_table(spark):
    from millrace.llm import queries
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op11_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and 40 < len(labels) < 120
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.9
    good, poor = ([got[r.doc_id].score for r in labels if r.quality == q] for q in (1, 0))
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in poor] for a in good]) > 0.93  # area under the curve
