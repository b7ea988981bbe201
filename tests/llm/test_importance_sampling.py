"""Target-distribution resampling: equal to the definition, copies counted once and multiplied."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from corpus_cases import EDGES, SF, needs_tables, prose

from millrace.llm import importance_sampling as isam
from millrace.llm.importance_sampling import Resampling

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def grams(text, longest):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[k:k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute_force(docs, target, how):
    """Row by row, every copy on its own."""
    place = lambda g: zlib.crc32(g.encode()) % how.buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(place, grams(text, how.longest)[1]))
    for text in target:
        t.update(map(place, grams(text, how.longest)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (big_s + how.buckets)) / ((s[b] + 1) * (big_t + how.buckets)))) for b in range(how.buckets)}
    rows = []
    for i, text in docs:
        n, g = grams(text, how.longest)
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(x)] for x in g)
        rows.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= how.min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = fit[:len(fit) * how.percent // 100]
    out = [(*r, k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in fit[len(drawn):]] + [(*r, None) for r in rows if r[1] < how.min_words]
    return sorted(out, key=str)


def found(spark, documents, docs, target, how):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = isam.resample(documents(docs), texts, how)
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str)


TARGET = [prose(3, 60), prose(3, 60), "Naïve DÉJÀ vu 42", None, ""]


@pytest.mark.parametrize("how", [Resampling(), Resampling(longest=2, buckets=97, min_words=5, percent=50, seed="x"), Resampling(longest=3, percent=100, min_words=0)])
def test_equals_brute_force(spark, documents, how):
    copies = [(k, prose(2, 40)) for k in range(100, 260)]  # a text that most rows share
    docs = EDGES + [(k, prose(k, 3 * k)) for k in range(8, 40)] + copies + [(k, "A-b_c/D9é " * (k % 7)) for k in range(300, 320)]
    assert found(spark, documents, docs, TARGET, how) == brute_force(docs, TARGET, how)


def test_all_texts_rare(spark, documents):
    """More different texts than HOT: none goes back by broadcast."""
    docs = [(k, f"one {k} two {k % 7} three " * 5) for k in range(400)]
    how = Resampling(min_words=10, percent=7)
    assert found(spark, documents, docs, TARGET, how) == brute_force(docs, TARGET, how)


def test_empty_tables(spark, documents):
    assert found(spark, documents, [], TARGET, Resampling()) == []
    docs = [(k, prose(k, 25)) for k in range(30)]
    assert found(spark, documents, docs, [], Resampling()) == brute_force(docs, [], Resampling())
    few = [(1, "too short"), (2, None)]
    assert [r[-1] for r in found(spark, documents, few, TARGET, Resampling())] == [None, None]


def test_draws_towards_the_target(spark, documents):
    """Texts in the words of the target are drawn far more often than others."""
    docs = [(k, prose(k, 40)) for k in range(100)] + [(k, "alpha beta gamma delta epsilon zeta " * 6 + f"n{k}") for k in range(100, 200)]
    got = found(spark, documents, docs, ["gamma beta alpha zeta " * 300, "epsilon delta alpha gamma " * 300], Resampling(percent=20))
    drawn = [r[0] for r in got if r[-1] is not None]
    assert len(drawn) == 40 and sum(i >= 100 for i in drawn) >= 38


@needs_tables
def test_query_equals_brute_force_on_the_table(spark):
    from millrace.llm import queries
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_importance_resampling(spark, SF).collect()), key=str)
    assert got == sorted(((i, n, w, s, k) for i, _, n, w, s, k in brute_force(docs, target, Resampling())), key=str)
