"""Operators over the whole corpus: suffixes, lines, exact and near copies, language model, pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_cases import EDGES, SF, needs_tables, prose
from pyspark.sql import functions as F

from millrace.llm import components, exact_dedup, line_dedup, minhash_dedup, ngram_lm, queries, suffix_dedup, suffix_sort


# --- suffix sorting and repeated substrings
@pytest.fixture(params=[4, 1 << 16])
def block(request, monkeypatch):
    monkeypatch.setattr(suffix_sort, "BLOCK", request.param)


def test_suffix_array_and_common_prefixes(block):
    rng = random.Random(1)
    for _ in range(120):
        t = np.array([rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(1, 60))] + [0], np.int16)
        s = t.tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        spill = rng.choice([0, 1 << 20])
        assert suffix_sort.suffix_order(t, spill, rng.choice([2, 1 << 20])).tolist() == want
        out = list(suffix_sort.sorted_suffixes(t, 5, spill, 2))
        pos, lcp = (np.concatenate(x) for x in zip(*out))
        assert pos[::-1].tolist() == want
        for i in range(1, len(pos)):
            a, b = s[pos[i - 1]:], s[pos[i]:]
            n = next((k for k in range(min(5, len(a), len(b))) if a[k] != b[k]), min(5, len(a), len(b)))
            assert n == lcp[i]


def test_repeated_windows(block):
    rng = random.Random(2)
    for _ in range(150):
        width = rng.randint(1, 6)
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        got = [[False] * len(p) for p in parts]
        for k, a, b in zip(*suffix_sort.repeated_windows(parts, width, rng.choice([0, 1 << 20]), rng.choice([2, 1 << 20]))):
            got[k][a:b] = [True] * (b - a)
        seen = set()
        for k, p in enumerate(parts):
            want = [False] * len(p)
            for i in range(len(p) - width + 1):
                if p[i:i + width] in seen:
                    want[i:i + width] = [True] * width
                seen.add(p[i:i + width])
            assert got[k] == want


def as_rows(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_remove_repeats(documents):
    base = " ".join(prose(k, 60) for k in range(5))
    rows = [(k, prose(k + 10, 20) + base[k * 13:k * 13 + 90 + k * 7] + prose(k + 30, 15)) for k in range(30)]
    rows += [(40, "ab" * 2000), (41, "ab" * 90), (42, "é" * 300), (43, ""), (44, None), (45, base), (46, base), (47, "=" * 5000)]
    want = suffix_dedup.brute_force([(i, (t or "").encode()) for i, t in rows])
    for memory in (16_000_000, 100):
        assert as_rows(suffix_dedup.remove_repeats(documents(rows).repartition(5), memory=memory)) == sorted(want)


def test_remove_repeats_edges(documents):
    rows = suffix_dedup.remove_repeats(documents(EDGES)).collect()
    assert len(rows) == len(EDGES) and sum(r.doc_id is None for r in rows) == 1
    same = documents([(1, prose(1, 80)), (1, prose(1, 80)), (None, prose(1, 80))])
    assert sorted(r.n_removed == r.n_bytes for r in suffix_dedup.remove_repeats(same).collect()) == [False, True, True]
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def test_suffix_shards_are_bounded_when_a_line_is_common(documents, monkeypatch):
    """One line under the width in many contexts: its key's different segments pass any bound, a task's shard must not."""
    rng = random.Random(4)
    line, text = "all rights reserved, see the notice on page one of it, and no part may be copied by anyone", lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(k, f"{text(70)}\n{line}\n{text(70)}") for k in range(150)]
    rows += [(200 + k, rows[k][1][20:] + text(30)) for k in range(0, 150, 3)] + [(400, rows[5][1]), (None, rows[9][1][:130])]
    want = suffix_dedup.brute_force([(i if i is not None else -1, t.encode()) for i, t in rows])
    memory, plain = 3000, suffix_dedup._repeats

    def checked(width, bound):
        inner = plain(width, bound)

        def run(batches):
            def watched():
                sums = {}
                for batch in batches:
                    for key, part in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                        sums[key] = sums.get(key, 0) + len(part)
                        if sums[key] > bound:
                            raise AssertionError("a key of more than the bound in one task")
                    yield batch
            yield from inner(watched())

        return run

    monkeypatch.setattr(suffix_dedup, "_repeats", checked)
    got = suffix_dedup.remove_repeats(documents(rows).repartition(5), memory=memory).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)


def test_suffix_shards_hold_their_bound(monkeypatch):
    """However much text a task gets, a shard holds ``memory`` bytes at most, whole keys, and the default leaves room for the sorts of an executor."""
    import inspect
    import tracemalloc

    import pyarrow as pa

    def batches(sizes, width):
        rng = random.Random(9)
        rows = [(key, n, 0, 0, rng.randbytes(width)) for key, size in enumerate(sizes) for n in range(size // width)]
        for at in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 1000]), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                             names=["key", "id", "copy", "first", "text"])

    shards, plain = [], suffix_sort.repeated_windows
    monkeypatch.setattr(suffix_sort, "repeated_windows", lambda parts, *a: shards.append(sum(map(len, parts))) or plain(parts, *a))
    sizes = [900, 900, 100, 500, 400, 200, 1000, 700]
    list(suffix_dedup._repeats(50, 1000)(batches(sizes, 50)))
    assert shards == [900, 1000, 900, 200, 1000, 700]
    memory = inspect.signature(suffix_dedup.remove_repeats).parameters["memory"].default
    tracemalloc.start()
    list(suffix_dedup._repeats(100, memory)(batches([1300] * 4000, 130)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6



# --- lines
@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(4, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b))
            b[k:k + rng.randint(0, 1)] = [rng.choice("abé")][: rng.randint(0, 1) if len(b) > 4 else 1]
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "x string, y string").filter(F.abs(F.length("x") - F.length("y")) <= edits)
    bad = df.filter(F.least(line_dedup.banded_distance("x", "y", edits), F.lit(edits + 1)) != F.least(F.levenshtein("x", "y"), F.lit(edits + 1)))
    assert df.count() > 100 and bad.count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_dedup_lines_equals_brute_force(documents, edits):
    rng = random.Random(7)
    base = [prose(k, 6) for k in range(12)]

    def line():
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            k = rng.randrange(len(s))
            s[k:k + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        return "".join(s)

    rows = [(k, "\n".join(line() if rng.random() < 0.8 else rng.choice(["", " \t", "short", "shore", "x"]) for _ in range(rng.randint(0, 6)))) for k in range(40)]
    places = [(k, n, x) for k, t in rows for n, x in enumerate(t.split("\n"))]
    want = {}
    for k, t in rows:
        keep = [x for n, x in enumerate(t.split("\n")) if not x.strip() or not any(
            (a, b) < (k, n) and (x == y or min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits) for a, b, y in places)]
        want[k] = "\n".join(keep)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(rows).repartition(4), edits=edits).collect()}
    assert got == want


def test_dedup_lines_of_a_hot_segment(documents, monkeypatch):
    """Many lines of one length that share a half: found without the pairs of the half, with the same result."""
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rng = random.Random(3)
    met, plain = [], line_dedup._hot_pairs

    def counted(*args):
        pairs = plain(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_dedup, "_hot_pairs", counted)
    lines = [f"order of the day {a}{b}{c}{d}" for a in "ab" for b in "ab" for c in "xyé" for d in "pqrst"]  # 21 characters
    lines = [x for x in lines if rng.random() < 0.4] * 2 + [f"{x[:k]}{x[k + 1:]}" for x in lines[::3] for k in (2, 20)] + [x + "!" for x in lines[::4]]
    lines += [f"{a}{b} day of all the days {c}" for a in "abcdefgh" for b in "abcdefgh" for c in "xy" if rng.random() < 0.5]
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[k::30])) for k in range(30)]
    want, seen = {}, []
    for k, t in rows:
        want[k] = "\n".join(x for x in t.split("\n") if not [y for y in [seen.append(x)] + seen[:-1] if y is not None and (
            x == y or min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1)])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(rows).repartition(4)).collect()}
    assert got == want and met[0] > 20


def test_dedup_lines_edges(documents):
    out = line_dedup.dedup_lines(documents(EDGES))
    assert out.count() == len(EDGES) and out.columns[:4] == ["doc_id", "text", "lang", "source"]
    assert [(r.doc_id, r.n_removed, r.text) for r in out.filter("n_removed > 0").collect()] == [(6, 1, "")] * 2  # short, and equal to that of 4
    assert line_dedup.dedup_lines(documents([])).count() == 0
    line = "this line is longer than twenty characters"
    got = line_dedup.dedup_lines(documents([(None, line), (1, line), (2, f"{line}\n{line}")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 1), (2, 2)]


# --- exact copies
def test_exact_duplicates(documents):
    rows = EDGES + [(8, "x"), (9, "y")] + [(100 + k, "hot") for k in range(50)]
    for cells in (1 << 29, 1 << 15):
        got = exact_dedup.exact_duplicates(documents(rows), max_cells=cells, bits_per_row=1).collect()
        assert len(got) == len(rows)
        by = defaultdict(list)
        for i, t in rows:
            by[t or ""].append(i)
        for r in got:
            assert r.group_size in {len(v) for v in by.values()} and r.kept == (r.doc_id == r.keep_id)
        assert {r.keep_id for r in got if r.group_size == 50} == {149} and {r.keep_id for r in got if r.group_size == 4} == {8}
    assert exact_dedup.exact_duplicates(documents([])).count() == 0


def test_cells_seen_twice(spark):
    """The merged bitmap against counting, with sparse and dense buckets and any number of tasks."""
    rng = random.Random(3)
    rows = [(f"d{min(rng.randrange(9000), rng.randrange(9000))}",) for _ in range(9000)]
    df = spark.createDataFrame(rows, "text_sha256 string")
    for n_cells, parts in ((1 << 15, 1), (1 << 15, 6), (1 << 18, 5)):
        cells = df.select(F.explode(F.array_distinct(F.array(*exact_dedup._cells(n_cells, 2)))).alias("c"))
        want = {r.c for r in cells.groupBy("c").count().filter("count > 1").collect()}
        got = set()
        for r in exact_dedup.seen_twice(df.repartition(parts), n_cells, 2).collect():
            got |= {(r.bucket - 1) * 32768 + int(k) + 1 for k in np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little"))}
        assert got == want


# --- near copies
def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (rng.integers(1, 200), rng.integers(0, 100), rng.integers(0, 100)))
        sig = minhash_dedup.superminhash(np.concatenate([both, a, both, b]), np.array([len(both) + len(a), len(both) + len(b)]))
        errors.append((sig[0] == sig[1]).mean() - len(both) / (len(both) + len(a) + len(b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045
    alone = minhash_dedup.superminhash(np.array([5], np.uint64), np.array([1]))
    assert sorted(np.floor(alone[0])) == list(range(96))  # one element: a permutation of the ranks


def near_brute(rows, width, percent):
    sets, n = [], len(rows)
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates_equal_brute_force(documents, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one TWO"), (5, "one")]
    for family in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(25):  # variants around the threshold
            v = list(words)
            for _ in range(rng.randint(0, 6)):
                v[rng.randrange(len(v))] = f"z{rng.randrange(9999)}"
            rows.append((len(rows) + 10, " ".join(v)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(documents(rows).repartition(3), 3, 85).collect()}
    assert got == near_brute(rows, 3, 85)


def test_near_duplicates_edges(documents):
    got = minhash_dedup.near_duplicates(documents(EDGES)).collect()
    assert len(got) == len(EDGES) and {r.doc_id: r.component_id for r in got if r.doc_id}[6] == 4
    assert all(r.component_id == r.doc_id for r in got if r.n_shingles == 0) and sum(r.kept for r in got if r.doc_id == 6) == 0
    assert minhash_dedup.near_duplicates(documents([])).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 480)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}


# --- language model
def kneser_ney(train, order):
    """The model by definition on token lists: count(context, word) at the top, words before a pair below (raw at the start)."""
    triples, raw, words = Counter(), Counter(), Counter()
    for t in train:
        seq = [None, *t, "\n"]
        raw.update(zip(seq, seq[1:]))
        triples.update(zip(seq, seq[1:], seq[2:]))
        words.update(seq[1:])
    before_pair = Counter((v, w) for _, v, w in triples)
    pairs = raw if order == 2 else Counter({(v, w): c if v is None else before_pair[v, w] for (v, w), c in raw.items()})
    times = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    before = Counter(w for _, w in pairs)
    d3, d2, d1 = ((0.0, *ngram_lm.discounts(*times(c))) for c in (triples, pairs, before))
    types, v = len(pairs), len(before)
    mass = sum(d1[min(c, 3)] for c in before.values()) / types

    def level(counts, d, key):
        follow = defaultdict(list)
        for k, c in counts.items():
            follow[key(k)].append(c)

        def p(context, k, lower):
            if context not in follow:
                return lower
            total = sum(follow[context])
            return max(counts[k] - d[min(counts[k], 3)], 0) / total + sum(d[min(x, 3)] for x in follow[context]) / total * lower
        return p

    p2, p3 = level(pairs, d2, lambda k: k[0]), level(triples, d3, lambda k: k[:2])

    def p(u, a, w):
        one = max(before[w] - d1[min(before[w], 3)], 0) / types + mass / (v + 1)
        two = p2(a, (a, w), one)
        return two if order == 2 or a is None else p3((u, a), (u, a, w), two)

    return words, p


@pytest.mark.parametrize("order, shards", [(2, 1), (2, 7), (3, 1), (3, 7), (3, None)])
def test_language_model_equals_definition(spark, documents, monkeypatch, order, shards):
    monkeypatch.setattr(ngram_lm, "BUCKET", 4)
    rng = random.Random(10)
    rows = [(k, None if k == 3 else " ".join(f"W{min(rng.randrange(1, 40), rng.randrange(1, 40))}" for _ in range(rng.randint(0, 40)))) for k in range(120)]
    rows += [(200, "often " * 900), (201, "often often w1")]  # counts beyond a byte
    toks = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    learn = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    words, p = kneser_ney([toks(t) for _, t in learn], order)
    n, v = sum(words.values()), len(words)
    model = ngram_lm.train(documents(learn).repartition(5), order=order, shards=shards)
    assert (model.tokens, model.words) == (n, v)
    extra = rows + [(500, "never seen"), (None, "w1")]
    got = {r.doc_id: r for r in ngram_lm.score_texts(documents(extra), model).collect()}
    for i, t in extra:
        seq = [None, None, *toks(t), "\n"]
        assert got[i].score == pytest.approx(sum(math.log10(p(*g)) for g in zip(seq, seq[1:], seq[2:])))
        assert got[i].base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq[2:]))
        assert got[i].n_known == sum(words[w] > 0 for w in seq[2:]) and got[i].n_tokens == len(seq) - 2
    known = sorted(words)
    for context in ((None, None), (None, "w1"), ("w2", "w1"), ("no", "w3")):
        assert sum(p(*context, w) for w in known) + p(*context, "unseen") == pytest.approx(1.0)


@pytest.mark.parametrize("top", [1, 5, 1 << 20, 1 << 63])
def test_key_order_is_exact_and_blocks_come_back(top):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, top, 5_000).astype(np.uint64)
    assert np.array_equal(keys[ngram_lm.key_order(keys)], np.sort(keys))
    lead = np.repeat(keys[:50] << np.uint64(1), 3)  # keys that differ in their last bits only
    near = np.concatenate([lead ^ np.tile(np.array([2, 0, 1], np.uint64), 50), rng.integers(0, 1 << 63, 9_000).astype(np.uint64)])
    assert np.array_equal(near[ngram_lm.key_order(near)], np.sort(near))
    at, times = ngram_lm.counted(near)
    got = Counter()
    for k, n in zip(near[at].tolist(), times.tolist()):
        got[k] += n
    assert got == Counter(near.tolist())
    words = np.sort(keys >> np.uint64(16))
    counts = rng.integers(1, 400, 5_000)
    (back,), (again,) = ngram_lm.unpacked([ngram_lm.packed([words], [6], [counts])] * 2, [6], 1)
    assert np.array_equal(back, np.tile(words, 2)) and np.array_equal(again, np.tile(counts, 2))
    assert ngram_lm.key_order(np.zeros(0, np.uint64)).size == 0


def test_language_model_edges(documents):
    """Repeated rows score alike, long texts whole, an empty table gives nothing, and a lost file is an error, not a score."""
    import glob
    import os
    rows = [(1, "a b c"), (1, "a b c"), (2, "word " * 200_000), (3, None)]
    model = ngram_lm.train(documents(rows))
    got = ngram_lm.score_texts(documents(rows), model).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1 and {r.n_tokens for r in got} == {4, 200_001, 1}
    assert ngram_lm.score_texts(documents([]), model).count() == 0
    for f in glob.glob(f"{model.folder.removeprefix('file://')}/two-*-keys.npy"):
        os.remove(f)
    with pytest.raises(Exception, match="two-"):
        ngram_lm.score_texts(documents(rows), model).collect()


def test_language_model_of_nothing(documents):
    model = ngram_lm.train(documents([]))
    row = ngram_lm.score_texts(documents([(1, "a b")]), model).first()
    assert (row.n_tokens, row.n_known, row.score, row.base_score) == (3, 0, 0.0, 0.0)


# --- queries and pipeline
@needs_tables
@pytest.mark.parametrize("name", ["op6_line_dedup", "op7_exact_dedup", "op8_minhash_dedup"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in got.collect()) == sorted(tuple(map(str, r)) for r in cursor.fetchall())


@needs_tables
def test_suffix_query_against_brute_force(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_rows(queries.op3_suffix_dedup(spark, SF)) == suffix_dedup.brute_force(docs)


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline as cp
    assert [n for n, _ in cp.STAGES][2] == "near-copies" and len(cp.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    clean = cp.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and toxic <= {r.doc_id for r in clean.collect()}  # no clean labelled document goes
    cut = cp.cut_repeated_lines(spark, docs, SF)
    assert cut.columns == docs.columns and cut.filter("n_chars <> length(text)").count() == 0
    near = cp.drop_near_copies(spark, docs, SF)
    want = near_brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in want.items() if i == c}
    leaks = cp.drop_contaminated(spark, docs, SF)
    assert 0 < leaks.count() < docs.count()
    assert cp.run(spark, SF).filter("not round_trip").count() == 0


@needs_tables
def test_pipeline_edges(spark, documents):
    import corpus_pipeline as cp
    for rows in (EDGES, []):
        docs = documents(rows).select(*cp.COLUMNS)
        for _, stage in cp.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == list(cp.COLUMNS)
            assert stage(spark, docs, SF).count() <= len(rows)
        assert cp.STAGES[-1][1](spark, docs, SF).count() == len(rows)


@needs_tables
def test_pipeline_loses_no_row_of_a_repeated_or_null_id(spark, documents):
    """Rows that share an id, or have none, are documents of their own in every stage."""
    import corpus_pipeline as cp
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 100").first().text
    texts = [f"{prose(k, 40)} and number {k} {prose(k + 3, 30)}" for k in range(9)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[2]), (3, None), (3, ""), (4, texts[5]), (4, f"{texts[6]} {leak}"), (None, texts[7])]
    docs = documents(rows).select(*cp.COLUMNS)
    near = sorted((r.doc_id or 0, r.text or "") for r in cp.drop_near_copies(spark, docs.repartition(3), SF).collect())
    want = [(1, texts[0]), (1, texts[1]), (0, texts[3]), (2, texts[2]), (3, ""), (3, ""), (4, texts[5]), (4, f"{texts[6]} {leak}"), (0, texts[7])]
    assert near == sorted(want)
    clean = sorted((r.doc_id or 0, r.text or "") for r in cp.drop_contaminated(spark, docs.repartition(2), SF).collect())
    assert clean == sorted((i or 0, t or "") for i, t in rows if leak not in (t or ""))
    assert cp.encode(spark, docs, SF).count() == len(rows)
