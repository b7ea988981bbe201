"""Benchmark decontamination: a BM25 inverted index of test items searched with block-max WAND.

Every training passage (a window of words) is a query against the items; all items whose score reaches the
threshold are retrieved and then verified by the overlap of question and answer shingles.  Impacts are scaled
by the item's own score, so 1.0 means a passage holding every term of the item.

Scale: documents are never shuffled.  Items are dealt into shards of about ``shard_chars`` characters; a task builds the index of
a shard and writes it to the shared folder, so neither items nor indexes pass the driver, which holds a path a shard.  A worker
holds one index, with block maxima for the blocks that a term occurs in only.  A passage follows the lengths of a class of
items (within a factor of four), so one long item does not widen the passages of the others; passages of a document are
bounded a portion at a time, so memory does not grow with its length.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, read_bytes, shared_dir, staged, text_or_empty, write_bytes

TERM = re.compile(r"\w+")
K1, B = 1.2, 0.75


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence or line is the answer, all before it the question; of a single one, the last third of the words."""
    parts = [p for p in re.split(r"(?<=[.!?:])\s+|\n+", text.strip()) if TERM.search(p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3) if words else 0
    return " ".join(words[:cut]), " ".join(words[cut:])


def shingles(words: list[str], width: int = 5) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))}


class BlockMaxIndex:
    """Postings by term, sorted by item, in blocks of ``block`` items with the largest impact of each block that has one.

    items: (item_id, text); df: document frequency by term over all items; n: number of items; avg: mean length.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, avg: float, block: int = 4, width: int = 5):
        self.ids = [i for i, _ in items]
        tokens = [terms(t) for _, t in items]
        self.longest = max([1, *map(len, tokens)])
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, toks in enumerate(tokens):
            raw = {}
            for t, tf in Counter(toks).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                raw[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(toks) / max(avg, 1e-9)))
            own = sum(raw.values())
            for t, x in raw.items():
                postings[t].append((k, x / own))
        self.term_ids = {t: i + 1 for i, t in enumerate(sorted(postings))}  # 0: not in the index
        self.postings = [([], [])] + [tuple(map(list, zip(*postings[t]))) for t in sorted(postings)]
        self.block, self.blocks = block, -(-len(items) // block) or 1
        self.block_max: list[dict[int, float]] = []
        for ks, xs in self.postings:
            most: dict[int, float] = {}
            for k, x in zip(ks, xs):
                most[k // block] = max(most.get(k // block, 0.0), x)
            self.block_max.append(most)
        self.term_max = [max(most.values(), default=0.0) for most in self.block_max]
        # the same as arrays: blocks of term t are rows starts[t]:starts[t + 1]
        self.starts = np.cumsum([0, *map(len, self.block_max)])
        self.where = np.array([b for most in self.block_max for b in most], np.int64)
        self.most = np.array([x for most in self.block_max for x in most.values()], np.float64)
        self.question, self.answer = [], []
        self.widths = [min(width, len(toks)) for toks in tokens]  # short items are compared as a whole
        for (_, text), toks, w in zip(items, tokens, self.widths):
            q, _ = question_and_answer(text)
            cut = len(terms(q))
            whole = shingles(toks, w)
            asked = shingles(toks[:cut], w) & whole if cut >= w else set()
            self.question.append(asked)
            self.answer.append(whole - asked)  # with the words before it, so short answers have shingles too

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold for the distinct terms of ``query``, by block-max WAND."""
        lists = [(t, self.postings[t][0], self.postings[t][1]) for t in set(query) if t]
        heap = [(ks[0], i, 0) for i, (_, ks, _) in enumerate(lists)]
        heapq.heapify(heap)
        out, slack = [], 1e-6
        while heap:
            ordered, total, pivot = sorted(heap), 0.0, None
            for at, (k, i, _) in enumerate(ordered):
                total += self.term_max[lists[i][0]]
                if total + slack >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return out
            b = pivot // self.block
            bound = sum(self.block_max[lists[i][0]].get(b, 0.0) for k, i, _ in ordered if k <= pivot)
            if bound + slack < threshold:  # nothing of this block can reach it with the terms up to the pivot
                target = min([(b + 1) * self.block, *(k for k, _, _ in ordered if k > pivot)])
            elif ordered[0][0] < pivot:
                target = pivot
            else:
                score = sum(lists[i][2][p] for k, i, p in ordered if k == pivot)
                if score + 1e-12 >= threshold:
                    out.append((pivot, score))
                target = pivot + 1
            heap = []
            for k, i, p in ordered:
                ks = lists[i][1]
                while p < len(ks) and ks[p] < target:
                    p += 1
                if p < len(ks):
                    heap.append((ks[p], i, p))
            heapq.heapify(heap)
        return out

    def _block_sums(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Sums of the block maxima of (row, term) pairs, one row of all blocks each."""
        n = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(np.repeat(row, n) * self.blocks + self.where[at], self.most[at], rows * self.blocks).reshape(rows, self.blocks)

    def passages(self, ids: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """Windows (start, end) whose bound by block maxima can reach the threshold.

        Windows are 1.5 times the longest item with a stride of half of it, so every item lies whole in one.  The
        block maxima of the distinct terms are summed for each half item, a window's bound is the sum of its three
        halves; what is left is bounded again by the distinct terms of the window.  ``PORTION`` numbers are held at a time.
        """
        half, terms_ = -(-self.longest // 2), len(self.postings)
        halves = max(1, -(-len(ids) // half))
        at = np.flatnonzero(ids)
        pair = np.unique(at // half * terms_ + ids[at])
        owner = pair // terms_
        term = pair - owner * terms_
        ends = np.searchsorted(owner, np.arange(halves + 1))
        work = np.concatenate([[0], np.cumsum(self.starts[term + 1] - self.starts[term])])[ends] + np.arange(halves + 1) * self.blocks
        windows, w0 = max(1, halves - 2), 0
        while w0 < windows:
            w1 = min(windows, max(w0 + 1, int(np.searchsorted(work, work[w0] + PORTION, "right")) - 3))
            h1 = min(halves, w1 + 2)
            part = slice(ends[w0], ends[h1])
            each = self._block_sums(owner[part] - w0, term[part], h1 - w0)
            bound = each[:w1 - w0].copy()
            for k in (1, 2):
                more = each[k:k + w1 - w0]
                bound[:len(more)] += more
            for w in (w0 + np.flatnonzero(bound.max(axis=1) + SLACK >= threshold)).tolist():
                s, e = w * half, min((w + 3) * half, len(ids))
                own = np.unique(ids[s:e])
                if self._block_sums(np.zeros(len(own), np.int64), own, 1).max() + SLACK >= threshold:
                    yield s, e
            w0 = w1

    def overlaps(self, item: int, have: dict[int, set]) -> tuple[float, float, float]:
        """Shares of the item's question shingles, answer shingles and all shingles among those of a window, by width."""
        q, a, own = self.question[item], self.answer[item], have[self.widths[item]]
        nq, na = len(q & own), len(a & own)
        return (nq / len(q) if q else 1.0), (na / len(a) if a else 1.0), (nq + na) / max(1, len(q) + len(a))


#: Numbers that the bounds of one portion of a document hold, and what rounding of sums of doubles may lose.
PORTION, SLACK = 1_000_000, 1e-9


def length_class(n_terms: int) -> int:
    """Items of one class have passages of one length: 1-4, 5-15, 16-63, 64-255, ... terms."""
    return 0 if n_terms < 5 else (n_terms.bit_length() + 1) // 2


class Shard:
    """The indexes of a shard of items, one for each class of lengths."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, avg: float):
        by_class: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for item in sorted(items):
            by_class[length_class(len(terms(item[1])))].append(item)
        self.indexes = [BlockMaxIndex(by_class[k], df, n, avg) for k in sorted(by_class)]

    def hits(self, text: str, threshold: float, min_overlap: float) -> list[tuple]:
        """(item_id, start_word, score, question, answer, overlap) of the best verified window of every item found."""
        toks, out = terms(text), []
        for index in self.indexes:
            ids = np.fromiter(map(index.term_ids.get, toks, repeat(0)), np.int64, len(toks))
            best: dict[int, tuple] = {}
            for s, e in index.passages(ids, threshold):
                have = None
                for item, score in index.search(ids[s:e].tolist(), threshold):
                    have = have or {w: shingles(toks[s:e], w) for w in set(index.widths)}
                    q, a, both = index.overlaps(item, have)
                    if both >= min_overlap and q >= 0.5 and a >= 0.5:
                        best[item] = max(best.get(item, (-1.0,)), (both, score, -s, q, a))
            out += [(index.ids[i], -s, score, q, a, both) for i, (both, score, s, q, a) in sorted(best.items())]
        return out


HITS = "doc_id long, item_id long, start_word long, score double, question_overlap double, answer_overlap double, overlap double"


def search_documents(docs: DataFrame, folder: str, name: str, threshold: float, min_overlap: float, id_col: str) -> DataFrame:
    """Best verified window of every (document, item) pair for one shard, whose index a task reads from the shared folder."""
    def search(batches):
        shard = pickle.loads(read_bytes(folder, name))  # written by build_shards below
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for hit in shard.hits(text, threshold, min_overlap)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[x.split()[0] for x in HITS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(search, HITS)


def _split(batches):
    for batch in batches:
        lists = [terms(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([len(x) for x in lists], pa.int64()), pa.array([sorted(set(x)) for x in lists], pa.list_(pa.string()))],
            names=["item_id", "text", "length", "terms"])


def build_shards(benchmark: DataFrame, shard_chars: int) -> tuple[str, list[str]]:
    """Write the index of every shard into a new folder of the shared folder; returns it and the names of its files."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    seen = staged(items.mapInArrow(_split, "item_id long, text string, length long, terms array<string>").filter("length > 0"), "items")
    total = seen.agg(F.count("*").alias("n"), F.avg("length").alias("words"), F.sum(F.length("text")).alias("chars")).first()
    folder, n, avg = f"{shared_dir(spark)}/millrace/items-{uuid.uuid4().hex}", int(total.n), float(total.words or 0.0)
    shards = max(1, -(-int(total.chars or 0) // shard_chars))
    dealt = seen.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    frequency = seen.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    needed = dealt.select(F.col("shard").alias("of"), F.explode("terms").alias("term")).distinct().join(frequency, "term")

    def build(rows: pa.Table, df: pa.Table) -> pa.Table:
        pairs = list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()))
        index = Shard([(i if i is not None else -1, t) for i, t in pairs], dict(zip(df.column("term").to_pylist(), df.column("df").to_pylist())), n, avg)
        name = f"shard-{rows.column('shard')[0].as_py()}"
        write_bytes(folder, name, pickle.dumps(index))
        return pa.table([pa.array([name])], names=["name"])

    names = (dealt.select("shard", "item_id", "text").groupBy("shard").cogroup(needed.groupBy("of")).applyInArrow(build, "name string"))
    found = sorted(r.name for r in names.collect())  # a short row a shard
    dropped(seen)
    return folder, found


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, min_overlap: float = 0.8,
                       shard_chars: int = 4_000_000, id_col: str = "doc_id") -> DataFrame:
    """One row per (document, test item) that the document leaks.

    Columns: doc_id, item_id, start_word (of the best window), score (share of the item's BM25 weight),
    question_overlap, answer_overlap, overlap (shares of five-word shingles; an item of fewer words is one shingle).  Items with
    null or wordless text are left out, a null item_id is -1; null documents count as empty; repeated documents give repeated
    rows, repeated items count once a text and id; an empty table on either side gives an empty result.
    """
    folder, names = build_shards(benchmark, shard_chars)
    out = None
    for name in names:
        hits = search_documents(docs, folder, name, threshold, min_overlap, id_col)
        out = hits if out is None else out.unionByName(hits)
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def brute_force(docs: list[tuple[int, str]], items: list[tuple[int, str]], threshold: float = 0.6, min_overlap: float = 0.8) -> set[tuple[int, int]]:
    """Every window against every item without index or bounds (for tests)."""
    items = [(i, t) for i, t in items if t and TERM.search(t)]
    toks = {item: terms(item[1]) for item in items}
    df = Counter(t for x in toks.values() for t in set(x))
    n, found = len(items), set()
    avg = sum(map(len, toks.values())) / max(1, n)
    for kind in {length_class(len(x)) for x in toks.values()}:
        same = [item for item in items if length_class(len(toks[item])) == kind]
        half = -(-max(len(toks[item]) for item in same) // 2)
        for doc, text in docs:
            words = terms(text or "")
            for s in range(0, max(1, len(words) - 2 * half), half):
                window = words[s:s + 3 * half]
                for item in same:
                    x = toks[item]
                    tf, width = Counter(x), min(5, len(x))
                    w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x) / avg)) for t, c in tf.items()}
                    if sum(w[t] for t in set(window) if t in w) / sum(w.values()) + 1e-12 < threshold:
                        continue
                    cut = len(terms(question_and_answer(item[1])[0]))
                    whole, have = shingles(x, width), shingles(window, width)
                    q = shingles(x[:cut], width) & whole if cut >= width else set()
                    share = lambda y: len(y & have) / len(y) if y else 1.0
                    if share(whole) >= min_overlap and share(q) >= 0.5 and share(whole - q) >= 0.5:
                        found.add((doc, item[0]))
    return found
