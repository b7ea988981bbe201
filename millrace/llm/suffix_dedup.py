"""Repeated-substring removal with suffix arrays built by external induced sorting.

Which bytes are covered by a ``width``-byte string that also starts earlier?

1. Anchors.  The window at byte p has as key the smallest hash of its ``width - anchor + 1`` strings of ``anchor``
   bytes, so equal windows have equal keys.  Runs of neighbouring windows with one key form a segment (about one in
   ``(width - anchor) / 2`` bytes).  A key that occurs once in the corpus belongs to no repeated window.
2. Segments meet by key.  One whose whole content came earlier is covered; one of several different segments of a key
   may share only a part and goes on to the suffix array, with its text.
3. A shard (all such segments of some whole keys, in corpus order, ``memory`` bytes of text at most) is sorted by external
   induced sorting, see ``suffix_sort``: neighbours in suffix order with a common prefix of ``width`` are equal windows, all but
   the first in corpus order are repeats.  A key with more than ``memory`` bytes of different segments (a short common
   line in many contexts) would be a shard that grows with the corpus: its windows are dealt by the hash of the whole
   window instead, and all but the first of equal ones are repeats.
4. The covered spans of each document are merged and cut out.

Scale: segments cross the network as 36-byte rows, the text twice at most through one reused exchange (once to fetch
segments, once to cut); identical segments never meet as pairs; a very common passage is one sorted run that streams
through its task, and so do the windows of a hot key; a suffix shard holds ``memory`` bytes of text at most, however large
the task, and spills its queues to disk.  Sorting takes about 100 bytes a byte of shard, in every task of an executor at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import U64, mixed, partitions, signed, staged, text_or_empty

WIDTH, ANCHOR = 100, 40
#: Bytes of text in a suffix shard.
MEMORY = 2_000_000
#: Windows of a segment at most (periodic texts would make endless ones).
LONGEST = 512
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_NULL_ID = -(1 << 63)


class RollingHash:
    """Polynomial hashes modulo 2**64 of all strings of one length in a buffer."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, self.base, U64)]), dtype=U64)
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, self.inverse, U64)]), dtype=U64)
        out = np.zeros(n, U64)
        np.cumsum((data.astype(U64) + U64(1)) * self.up[:n - 1], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64))


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbouring values by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def segments(texts: list[bytes], hashes: tuple[RollingHash, RollingHash], width: int = WIDTH, anchor: int = ANCHOR):
    """Segments of all texts: row of the text, first window, number of windows, key, content hash.

    The number is negative for segments that may repeat a window themselves: two equal windows of one segment make
    another occurrence of the smallest hash enter after its first window.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < width:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(U64), z.view(U64)
    first = np.cumsum(lengths) - lengths
    p1, p2 = hashes[0].prefix(data), hashes[1].prefix(data)
    n = len(data) - anchor + 1
    each = mixed((p1[anchor:] - p1[:n]) * hashes[0].down[:n])
    key = _smallest(each, width - anchor + 1)  # by window start
    counts = np.maximum(lengths - width + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
    key = key[start]
    enters = np.concatenate([[0], np.cumsum(each[start + (width - anchor)] == key)])
    new = np.ones(len(owner), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(owner)))
    if len(size) and size.max() > LONGEST:
        parts = -(-size // LONGEST)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(size, parts) - within * LONGEST
        at, size = np.repeat(at, parts) + within * LONGEST, np.minimum(left, LONGEST)
    begin = start[at]
    content = hashes[1].between(p2, begin, begin + size + width - 1)
    own = enters[at + size] > enters[at + 1]
    return owner[at], begin - first[owner[at]], np.where(own, -size, size), key[at], content


def _portions(texts: list[bytes], most: int = 1_000_000):
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


SEGMENT = "key long, content long, id long, copy int, first int, windows int"


def _find_segments(width: int, anchor: int):
    def find(batches):
        hashes = (RollingHash(_BASES[0]), RollingHash(_BASES[1]))
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).to_pylist()
            for a, b in _portions(texts):
                row, first, size, key, content = segments(texts[a:b], hashes, width, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(signed(content)), pa.array(ids[a:b][row]), pa.array(copies[a:b][row]),
                     pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["key", "content", "id", "copy", "first", "windows"])

    return find


FOUND = "key long, id long, copy int, first int, windows int, whole boolean"


def _meet(batches):
    """Streams segments sorted by key, content and place; passes repeats on, and the different segments of a key."""
    def rows(batch, at, whole):
        taken = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([taken.column(0), *taken.columns[2:5], pa.array(np.abs(taken.column(5).to_numpy())), pa.array(whole)],
                                          names=["key", "id", "copy", "first", "windows", "whole"])

    last_key = last_content = None
    many, pending = False, None  # is the current key known to have several contents; its first row, until then
    for batch in batches:
        if not batch.num_rows:
            continue
        key, content = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_key[0] = last_key is None or key[0] != last_key
        new = new_key.copy()
        new[1:] |= content[1:] != content[:-1]
        new[0] |= last_content is None or content[0] != last_content
        # different contents of each key in this batch
        run = np.cumsum(new_key)  # 0: the key carried over
        distinct = np.bincount(run[new], minlength=run[-1] + 1)
        several = distinct >= 2
        carried = pending is not None or many
        if not new_key[0] and carried and distinct[0] >= 1:
            several[0] = True
        windows = batch.column(5).to_numpy()
        own = windows < 0
        out = ~new | (new & (several[run] | own))
        extra = None
        if pending is not None and not new_key[0] and distinct[0] >= 1:
            extra, pending, many = pending, None, True
        keep = np.flatnonzero(out)
        if extra is not None:
            yield extra
        if len(keep):
            yield rows(batch, keep, ~new[keep])
        tail = run[-1]
        if tail > 0:  # a new key is the last one: hold its only content back, if it has just one
            row = np.flatnonzero(new & (run == tail))
            many, pending = bool(several[tail] or own[row[0]]), None
            if not many:
                pending = rows(batch, row, np.zeros(len(row), bool))
        last_key, last_content = key[-1], content[-1]


def _fetch(width: int):
    def fetch(batches):
        for batch in batches:
            rows = []
            for id_, copy, text, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                rows += [(w["key"], id_, copy, w["first"], text[w["first"]:w["first"] + w["windows"] + width - 1])
                         for w in wanted if w["copy"] == copy]
            for a in range(0, len(rows), 20_000):
                cols = list(zip(*rows[a:a + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                                 names=["key", "id", "copy", "first", "text"])

    return fetch


WINDOW = "key long, window long, id long, copy int, start int"


def _windows(width: int):
    """Every window of the segments of hot keys, by its hash."""
    def hashed(batches):
        hashes = RollingHash(_BASES[1])
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                key, id_, copy, first, text = batch.slice(a, 2000).columns
                texts = text.to_pylist()
                lengths = np.array([len(t) for t in texts], np.int64)
                counts = lengths - width + 1
                row = np.repeat(np.arange(len(texts)), counts)
                within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = (np.cumsum(lengths) - lengths)[row] + within
                prefix = hashes.prefix(np.frombuffer(b"".join(texts), np.uint8))
                window = hashes.between(prefix, at, at + width)
                start = (first.to_numpy()[row] + within).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.to_numpy()[row]), pa.array(signed(window)), pa.array(id_.to_numpy()[row]), pa.array(copy.to_numpy()[row]), pa.array(start)],
                    names=["key", "window", "id", "copy", "start"])

    return hashed


def _again(width: int):
    """Streams windows sorted by key, hash and place: all but the first of equal ones."""
    def again(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, window, start = (batch.column(k).to_numpy() for k in (0, 1, 4))
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (window[1:] == window[:-1])
            same[0] = last == (key[0], window[0])
            last = key[-1], window[-1]
            at = pa.array(np.flatnonzero(same))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in (2, 3)], pa.array(start[same]), pa.array(start[same] + np.int32(width))],
                                             names=["id", "copy", "start", "stop"])

    return again


SPAN = "id long, copy int, start int, stop int"


def _repeats(width: int, memory: int):
    from millrace.llm.suffix_sort import repeated_windows

    def sort(batches):
        rows: list[tuple] = []  # of whole keys
        same: list[tuple] = []  # of the key that is being read
        held, more, last = 0, 0, None

        def solve(rows):
            rows.sort(key=lambda r: (r[1], r[2], r[3]))
            seg, at, stop = repeated_windows([r[4] for r in rows], width, memory)
            cols = [[rows[k][1] for k in seg], [rows[k][2] for k in seg],
                    [rows[k][3] + a for k, a in zip(seg, at)], [rows[k][3] + b for k, b in zip(seg, stop)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                                              names=["id", "copy", "start", "stop"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != last:
                    rows += same
                    held, same, more, last = held + more, [], 0, row[0]
                if rows and held + more + len(row[4]) > memory:  # a shard ends only between keys
                    yield solve(rows)
                    rows, held = [], 0
                same.append(row)
                more += len(row[4])
        rows += same
        if rows:
            yield solve(rows)

    return sort


def _cut(batches):
    for batch in batches:
        out = [[] for _ in range(5)]
        for id_, copy, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
            kept, removed, runs, at = [], 0, 0, 0
            end = -1
            for a, b in sorted((s["start"], s["stop"]) for s in spans or () if s["copy"] == copy):
                if a > end:  # touching spans are one run
                    runs += 1
                    kept.append(text[at:a])
                    at = a
                if b > at:
                    removed += b - at
                    at = b
                end = max(end, b)
            kept.append(text[at:])
            for col, x in zip(out, (id_ if id_ != _NULL_ID else None, len(text), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest())):
                col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def covered_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, memory: int = MEMORY) -> tuple[DataFrame, DataFrame]:
    """(numbered documents (id, copy, text), spans (id, copy, start, stop) covered by an earlier string of ``width`` bytes)."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"),
                       text_or_empty().cast("binary").alias("text"))
    if base.groupBy("id").count().filter("count > 1").isEmpty():
        numbered = base.select("id", F.lit(0).alias("copy"), "text")
    else:  # rows that share an id: ordered by text, each a document of its own
        numbered = base.select("id", F.row_number().over(Window.partitionBy("id").orderBy("text")).alias("copy"), "text")
    n = partitions(spark)
    found = (numbered.mapInArrow(_find_segments(width, anchor), SEGMENT).repartition(n, "key")
             .sortWithinPartitions("key", "content", "id", "copy", "first").mapInArrow(_meet, FOUND))
    found = staged(found, "segments")
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of the step before
    several = found.filter("not whole")
    hot = staged(several.groupBy("key").agg(F.sum(F.col("windows").cast("long") + (width - 1)).alias("n"))
                 .filter(F.col("n") > memory).select("key"), "hot-keys")  # one for each ``memory`` bytes of text at most

    def fetched(rows):
        wanted = rows.groupBy("id").agg(F.collect_list(F.struct("copy", "key", "first", "windows")).alias("wanted"))
        return (numbered.join(wanted, "id").select("id", "copy", "text", "wanted")
                .mapInArrow(_fetch(width), "key long, id long, copy int, first int, text binary"))

    any_hot = not hot.isEmpty()
    cold = several.join(F.broadcast(hot), "key", "left_anti") if any_hot else several
    partial = fetched(cold).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_repeats(width, memory), SPAN)
    if any_hot:
        windows = fetched(several.join(F.broadcast(hot), "key", "left_semi")).mapInArrow(_windows(width), WINDOW)
        partial = partial.unionByName(windows.repartition(n, "key", "window").sortWithinPartitions("key", "window", "id", "copy", "start")
                                      .mapInArrow(_again(width), SPAN))
    whole = found.filter("whole").select("id", "copy", F.col("first").alias("start"),
                                         (F.col("first") + F.col("windows") + (width - 1)).alias("stop"))
    return numbered, whole.unionByName(partial)


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, memory: int = MEMORY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Every byte covered by a ``width``-byte string that also starts earlier goes (smaller doc_id, or an earlier start in
    the same document); matches never cross documents.  Null counts as empty; a null id comes first; rows that share
    an id are documents in order of their texts.  Other columns are ignored; an empty table gives an empty result.
    """
    numbered, spans = covered_spans(docs, width, anchor, memory)
    per_doc = spans.groupBy("id").agg(F.collect_list(F.struct("copy", "start", "stop")).alias("spans"))
    return (numbered.join(per_doc, "id", "left").select("id", "copy", "text", "spans")
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def brute_force(docs: list[tuple[int, bytes]], width: int = WIDTH) -> list[tuple[int, int, int, int, str]]:
    """The same by a dictionary of all windows (for tests)."""
    seen: set[bytes] = set()
    out = []
    for id_, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - width + 1):
            w = text[p:p + width]
            if w in seen:
                gone[p:p + width] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((id_, len(text), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return out
