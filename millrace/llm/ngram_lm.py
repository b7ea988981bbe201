"""Language-model scoring: an interpolated modified Kneser-Ney model of two or three words.

Counting runs in Spark.  Every task pre-aggregates its n-grams (u, v, w) and sends each shard one packed block of them.  A shard
holds all n-grams of a range of hashed middle words v: it merges its blocks and so has complete counts of the n-grams, of
their contexts (u, v), of the pairs (v, w) with the number of different words before them, and of the contexts v.  These are
written as sorted hash arrays into the shared folder.  A second exchange merges right words (times seen, words before them).
Workers memory-map the arrays and score whole texts by binary search; only discounts and totals pass through the driver.

Words are known by 48 bits of a hash, the first word of an n-gram by 40 of them (it only has to differ from others before the
same words).  A table holds, in order of a 64-bit key, the 32 bits of it behind those that choose one
of its buckets of about ``BUCKET`` entries, and its counts as one byte: the commonest rows of counts are numbered.  So known words, V and
the base score are exact up to collisions: two of n different words share 48 bits with probability of about n^2 / 2^49.

Scale: a frequent word or n-gram is one entry a task after pre-aggregation; the number of shards follows the size of the corpus
(``SHARD_BYTES`` of text for each), so tasks stay of one size, but for a very common middle word, whose n-grams share a
shard.  Files are written under a temporary name and renamed, so tasks that run again after a lost executor do no harm.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import U64, WordHashes, filesystem, mixed, partitions, shared_dir, text_or_empty, write_bytes

WORD_BYTES, FIRST_BYTES = 6, 5
_SHORT = U64(64 - 8 * WORD_BYTES)
#: No word holds white space, so these two are no words; NONE stands for "no word before".
START = U64(xxhash.xxh3_64_intdigest(b"\nstart")) >> _SHORT
END_MARK = b"\nend"
NONE = U64(0)
#: Words that a task gathers before it packs them.
FLUSH_TOKENS = 4_000_000
#: Bytes of text for each shard, and entries of a bucket of a hash array.
SHARD_BYTES, BUCKET = 32_000_000, 64
#: Frequent words stand many times in a block: a wide window and entropy codes leave a fifth less than the shuffle's own codec.
ZSTD_LEVEL = 3


def tokens(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of left words, of tokens, and the number of tokens of each text (its words, then one end)."""
    flat: list[bytes] = []
    lengths = np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split()
        flat += words
        flat.append(END_MARK)
        lengths[k] = len(words) + 1
    right = cache.of(flat) >> _SHORT
    left = np.empty_like(right)
    left[1:] = right[:-1]
    left[np.cumsum(lengths) - lengths] = START
    return left, right, lengths


def before_left(left: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before the left word of every token; NONE where the left word is the start."""
    out = np.empty_like(left)
    out[1:] = left[:-1]
    out[np.cumsum(lengths) - lengths] = NONE
    return out


def word_keys(word: np.ndarray) -> np.ndarray:
    return mixed(word + U64(1))


def as_first(word: np.ndarray) -> np.ndarray:
    """What is kept of a word that begins an n-gram."""
    return word >> U64(8 * (WORD_BYTES - FIRST_BYTES))


def pair_keys(first: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of pairs; first: as_first of the left word."""
    return mixed(word_keys(first) ^ (right * U64(0x9E3779B97F4A7C15)))


def triple_keys(first: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Keys of n-grams; first: as_first of their first word, pair: key of the pair behind it."""
    return mixed(pair ^ mixed(first + U64(0xD1B54A32D192ED03)))


def shard_of(word: np.ndarray, shards: int) -> np.ndarray:
    return ((word_keys(word) >> U64(40)) % U64(shards)).astype(np.int64)


def nearly_ordered(keys: np.ndarray) -> np.ndarray:
    """Rows in order of the leading bits of 64-bit keys that their own numbers leave: one sort of plain numbers, no argsort.

    Rows of equal keys lie together, but where another key shares those bits.
    """
    low = (U64(1) << U64(len(keys).bit_length())) - U64(1)
    return (np.sort(keys & ~low | np.arange(len(keys), dtype=U64)) & low).astype(np.int64)


def key_order(keys: np.ndarray) -> np.ndarray:
    """Rows in order of 64-bit keys."""
    order, bits = nearly_ordered(keys), U64(len(keys).bit_length())
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong) > 10_000:  # keys whose leading bits say little
        return np.argsort(keys)
    lead = found >> bits
    for value in np.unique(lead[wrong]):
        rows = slice(*np.searchsorted(lead, [value, value + U64(1)]))
        order[rows] = order[rows][np.argsort(found[rows])]
    return order


def merged(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, a row of each, and sums of ``columns`` by key."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), [c.astype(np.int64) for c in columns]
    order = key_order(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], order[first], [np.add.reduceat(c[order].astype(np.int64), first) for c in columns]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each key and how often it occurs; a key that shares its leading bits with another may stand twice."""
    order = nearly_ordered(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order[first], np.diff(np.append(first, len(keys)))


# --- packed columns
def _short(words: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _long(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(U64)


def _mostly_ones(counts: np.ndarray) -> list[bytes]:
    """Places of the counts other than one, these as bytes, and those of them that do not fit (255 there)."""
    at = np.flatnonzero(counts != 1)
    other = counts[at]
    return [at.astype("<u4").tobytes(), np.minimum(other, 255).astype(np.uint8).tobytes(), other[other >= 255].astype("<i8").tobytes()]


def _with_ones(n: int, at: bytes, small: bytes, large: bytes) -> np.ndarray:
    out, other = np.ones(n, np.int64), np.frombuffer(small, np.uint8).astype(np.int64)
    other[other == 255] = np.frombuffer(large, "<i8")
    out[np.frombuffer(at, "<u4")] = other
    return out


def packed(words: list[np.ndarray], widths: list[int], counts: list[np.ndarray]) -> bytes:
    """A compressed block of rows, those of a word of the first column together: its runs, the other words, the counts."""
    first = words[0]
    at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    parts = [_short(first[at], widths[0]), *_mostly_ones(np.diff(np.append(at, len(first))))]
    parts += [_short(w, n) for w, n in zip(words[1:], widths[1:])]
    for c in counts:
        parts += _mostly_ones(c)
    block = np.array([len(first), len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)
    return np.array([len(block)], "<i8").tobytes() + pa.Codec("zstd", ZSTD_LEVEL).compress(block, asbytes=True)


def unpacked(blocks: list[bytes], widths: list[int], n_counts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of all blocks, one after the other."""
    words, counts = [[np.zeros(0, U64)] for _ in widths], [[np.zeros(0, np.int64)] for _ in range(n_counts)]
    for data in blocks:
        block = pa.Codec("zstd").decompress(memoryview(data)[8:], int(np.frombuffer(data, "<i8", 1)[0]), asbytes=True)
        rows, n = np.frombuffer(block, "<u4", 2).tolist()
        sizes = np.frombuffer(block, "<u4", n, 8)
        ends = (8 + 4 * n + np.cumsum(sizes, dtype=np.int64)).tolist()
        parts = [block[e - size:e] for e, size in zip(ends, sizes.tolist())]
        first = _long(parts[0], widths[0])
        words[0].append(np.repeat(first, _with_ones(len(first), *parts[1:4])))
        for k in range(1, len(widths)):
            words[k].append(_long(parts[3 + k], widths[k]))
        for k in range(n_counts):
            begin = 3 + len(widths) + 3 * k
            counts[k].append(_with_ones(rows, *parts[begin:begin + 3]))
    return [np.concatenate(w) for w in words], [np.concatenate(c) for c in counts]


# --- hash arrays in the shared folder
def save_array(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array into the shared folder in numpy's file format."""
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(array))
    write_bytes(folder, f"{name}.npy", head.getvalue(), array.tobytes())


def mapped_array(folder: str, name: str) -> np.ndarray:
    """Memory-map an array of the shared folder; from a store without paths it is fetched into this worker's temp first."""
    files, base = filesystem(folder)
    path = f"{base}/{name}.npy"
    if type(files).__name__ == "LocalFileSystem":
        return np.load(path, mmap_mode="r")
    with tempfile.NamedTemporaryFile(suffix=".npy", delete=False) as local, files.open_input_stream(path) as src:
        while block := src.read(1 << 20):
            local.write(block)
    array = np.load(local.name, mmap_mode="r")
    os.unlink(local.name)  # the mapping keeps the pages
    return array


def save_table(folder: str, name: str, keys: np.ndarray, counts: list[np.ndarray]) -> None:
    """Rows of counts by sorted distinct key: starts of buckets, 32 bits of each key, and a byte a row.

    The byte is the number of one of the 255 commonest rows of counts; all others (255) stand in a list with their places.
    """
    bits = max(0, (len(keys) // BUCKET).bit_length())
    starts = np.searchsorted(keys >> U64(64 - bits), np.arange(1 << bits, dtype=U64)) if bits else np.zeros(1, np.int64)
    rows = np.stack(counts, axis=1).astype("<i8")
    mark = np.zeros(len(rows), U64)
    for column in counts:
        mark = mixed(mark ^ (column.astype(U64) + U64(1))) * U64(0x9E3779B97F4A7C15)
    _, first, which, times = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-times, kind="stable")[:255]
    code = np.full(len(times), 255, np.uint8)
    code[common] = np.arange(len(common))
    code = code[which]
    other = np.flatnonzero(code == 255)
    for part, x in (("starts", np.append(starts, len(keys)).astype("<i8")), ("keys", ((keys << U64(bits)) >> U64(32)).astype("<u4")),
                    ("codes", code), ("common", rows[first[common]]), ("place", other.astype("<i8")), ("other", rows[other])):
        save_array(folder, f"{name}-{part}", x)


class Table:
    """A memory-mapped table of save_table."""

    def __init__(self, folder: str, name: str):
        self.starts, self.keys, self.codes, self.common, self.place, self.other = (
            mapped_array(folder, f"{name}-{x}") for x in ("starts", "keys", "codes", "common", "place", "other"))
        self.bits = (len(self.starts) - 1).bit_length() - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A row of counts for each key, zeros where it is missing."""
        out = np.zeros((len(keys), self.common.shape[1]), np.int64)
        bucket = (keys >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        low, end = self.starts[bucket], self.starts[bucket + 1]
        high, rest = end.copy(), ((keys << U64(self.bits)) >> U64(32)).astype(np.uint32)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self.keys[middle] < rest[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        hit = np.flatnonzero(low < end)
        hit = hit[self.keys[low[hit]] == rest[hit]]
        code = self.codes[low[hit]]
        rare = np.flatnonzero(code == 255)
        usual = np.flatnonzero(code != 255)
        out[hit[usual]] = self.common[code[usual]]
        out[hit[rare]] = self.other[np.searchsorted(self.place, low[hit[rare]])]
        return out


# --- counting
def _by_shard(shard: np.ndarray, first: np.ndarray, shards: int):
    """(shard, rows of it, those of a first word together as a rule) of every shard that has rows."""
    bits = shards.bit_length()
    order = nearly_ordered(shard.astype(U64) << U64(64 - bits) | first << _SHORT >> U64(bits))
    if bits + len(order).bit_length() > 64:  # the leading bits must tell all shards apart
        order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        yield s, order[ends[s]:ends[s + 1]]


#: Bytes of the words of an entry: middle, right, first.
WIDTHS = [WORD_BYTES, WORD_BYTES, FIRST_BYTES]


def _count(order: int, shards: int):
    def emit(held):
        u, v, w = (np.concatenate(x) for x in held)
        u, keys = as_first(u), pair_keys(as_first(v), w)
        at, count = counted(triple_keys(u, keys) if order == 3 else keys)
        u, v, w = u[at], v[at], w[at]
        ids, blocks = [], []
        for s, rows in _by_shard(shard_of(v, shards), v, shards):
            ids.append(s)
            blocks.append(packed([v[rows], w[rows], u[rows]][:order], WIDTHS[:order], [count[rows]]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "block"])

    def count(batches: Iterator[pa.RecordBatch]):
        cache, held, size = WordHashes(), ([], [], []), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 300):
                left, right, lengths = tokens(texts[at:at + 300], cache)
                for column, x in zip(held, (before_left(left, lengths), left, right)):
                    column.append(x)
                size += len(left)
                if size >= FLUSH_TOKENS:
                    yield emit(held)
                    held, size = ([], [], []), 0
        if size:
            yield emit(held)

    return count


def _times(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int(np.sum(counts == k)) for k in (1, 2, 3, 4)]


#: How many counts of n-grams of three words, and of pairs, are 1, 2, 3 and 4.
TIMES = [f"{k}{i}" for k in ("top", "pair") for i in (1, 2, 3, 4)]
PART = pa.schema([("shard", pa.int32()), ("block", pa.binary()), ("writer", pa.int32()), *[(c, pa.int64()) for c in TIMES]])
PART_DDL = "shard int, block binary, writer int, " + ", ".join(f"{c} long" for c in TIMES)


def _merge(folder: str, shards: int, order: int):
    """Write the tables of a shard; pass blocks of right words on, and a row (shard -1) with the times of its counts."""
    def merge(table: pa.Table) -> pa.Table:
        shard = table.column(0)[0].as_py()
        (v, w, *first), (count,) = unpacked(table.column(1).to_pylist(), WIDTHS[:order], 1)
        pair = pair_keys(as_first(v), w)
        top, adjusted = [0] * 4, count
        if order == 3:
            keys, at, (count,) = merged(triple_keys(first[0], pair), count)
            u, v, w, pair = first[0][at], v[at], w[at], pair[at]
            inner = v != START
            save_table(folder, f"three-{shard}", keys[inner], [count[inner]])
            top = _times(count[inner])
            save_table(folder, f"context-three-{shard}", *_contexts(pair_keys(u[inner], v[inner]), count[inner]))
            adjusted = np.where(inner, 1, count)  # words before a pair; nothing stands before the start, its raw count counts
        pair, at, (adjusted, count) = merged(pair, adjusted, count)
        v, w = v[at], w[at]
        save_table(folder, f"two-{shard}", pair, [adjusted])
        save_table(folder, f"context-two-{shard}", *_contexts(word_keys(v), adjusted))
        _, at, (before, seen) = merged(w, np.ones(len(w), np.int64), count)
        word, ids, blocks = w[at], [], []
        for s, rows in _by_shard(shard_of(word, shards), word, shards):
            ids.append(s)
            blocks.append(packed([word[rows]], [WORD_BYTES], [before[rows], seen[rows]]))
        times = [*top, *_times(adjusted)]
        return pa.table([pa.array([*ids, -1], pa.int32()), pa.array([*blocks, b""], pa.binary()), pa.array([shard] * (len(ids) + 1), pa.int32()),
                         *[pa.array([0] * len(ids) + [x], pa.int64()) for x in times]], schema=PART)

    return merge


def _contexts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct context keys with their sums of counts and numbers of followers seen once, twice and more often."""
    keys, _, columns = merged(keys, counts, counts == 1, counts == 2, counts >= 3)
    return keys, columns


WORD_PART = ["shard", "words", "types", "tokens", "n1", "n2", "n3", "n4", "n3plus"]
TOTALS = pa.schema([*[(c, pa.int64()) for c in WORD_PART + TIMES], ("writers", pa.list_(pa.int32()))])
TOTALS_DDL = ", ".join(f"{c} long" for c in WORD_PART + TIMES) + ", writers array<int>"


def _merge_words(folder: str):
    """Write the words of a shard and give their totals; of the rows without words (shard -1) the sums and the writers."""
    def merge(table: pa.Table) -> pa.Table:
        shard = table.column(0)[0].as_py()
        if shard < 0:
            times = [sum(table.column(c).to_pylist()) for c in TIMES]
            row = [-1, *[0] * (len(WORD_PART) - 1), *times, table.column("writer").to_pylist()]
        else:
            (word,), (before, seen) = unpacked(table.column(1).to_pylist(), [WORD_BYTES], 2)
            keys, _, (before, seen) = merged(word_keys(word), before, seen)
            save_table(folder, f"words-{shard}", keys, [before, seen])
            row = [shard, len(keys), int(before.sum()), int(seen.sum()), *_times(before), int(np.sum(before >= 3)), *[0] * len(TIMES), []]
        return pa.table([pa.array([c], f.type) for c, f in zip(row, TOTALS)], schema=TOTALS)

    return merge


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more by the modified Kneser-Ney estimate; 0.5, 1, 1.5 where it is undefined."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= x <= k for k, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


@dataclass
class Model:
    """What a worker needs beside the mapped arrays."""

    folder: str
    order: int
    shards: int
    top_discounts: tuple[float, float, float]  # of n-grams of three words
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    tokens: int  # N
    words: int  # V
    types: int  # distinct pairs
    word_mass: float  # what the discounts of the unigram level free
    written: dict[str, frozenset]  # shards that have tables of n-grams, of words: one that is missing there is an error


def train(docs: DataFrame, text_col: str = "text", order: int = 3, shards: int | None = None) -> Model:
    """Count ``docs`` (null texts count as empty) and write the model of ``order`` 2 or 3 into a new folder of the shared folder."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(text_or_empty(text_col).cast("binary").alias("text"))
    if shards is None:
        size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        shards = max(partitions(spark), -(-int(size) // SHARD_BYTES))
    folder = f"{shared_dir(spark)}/millrace/lm-{uuid.uuid4().hex}"
    blocks = texts.mapInArrow(_count(order, shards), "shard int, block binary")
    parts = blocks.groupBy("shard").applyInArrow(_merge(folder, shards, order), PART_DDL)
    rows = parts.groupBy("shard").applyInArrow(_merge_words(folder), TOTALS_DDL).collect()  # a row of totals for each shard
    total = {c: sum(r[c] for r in rows) for c in WORD_PART + TIMES}
    word_d = discounts(total["n1"], total["n2"], total["n3"], total["n4"])
    mass = word_d[0] * total["n1"] + word_d[1] * total["n2"] + word_d[2] * total["n3plus"]
    top, pair = (discounts(*[total[f"{k}{i}"] for i in (1, 2, 3, 4)]) for k in ("top", "pair"))
    main, words = frozenset(w for r in rows for w in r.writers), frozenset(r.shard for r in rows if r.shard >= 0)
    return Model(folder, order, shards, top, pair, word_d, total["tokens"], total["words"], total["types"], mass,
                 {"three": main, "context-three": main, "two": main, "context-two": main, "words": words})


class Reader:
    """Memory-mapped tables of a model; lookups go shard by shard."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def lookup(self, name: str, by: np.ndarray, keys: np.ndarray, columns: int) -> np.ndarray:
        """Rows of counts by distinct key (zeros where it is missing); ``by``: the word that decides the shard."""
        out = np.zeros((len(keys), columns), np.int64)
        shard = shard_of(by, self.model.shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(ends)).tolist():
            if s not in self.model.written[name]:
                continue
            table = self.open.get((name, s))
            if table is None:
                table = self.open[name, s] = Table(self.model.folder, f"{name}-{s}")
            rows = order[ends[s]:ends[s + 1]]
            out[rows] = table.find(keys[rows])
        return out

    def score(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its training count, base log10 probability and the model's log10 probability."""
        m = self.model
        begin = np.cumsum(lengths) - lengths
        word, which = np.unique(np.append(right, START), return_inverse=True)
        behind = np.append(which[-1], which[:-2])  # of the left word
        behind[begin] = which[-1]
        before, seen = self.lookup("words", word, word_keys(word), 2)[which[:-1]].T
        base = np.log10((seen + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
        rest = m.word_mass / m.types if m.types else 1.0
        d = np.array([0.0, *m.word_discounts])
        p = np.maximum(before - d[np.minimum(before, 3)], 0.0) / max(m.types, 1) + rest / (m.words + 1)
        context = self.lookup("context-two", word, word_keys(word), 4)[behind]
        keys = pair_keys(as_first(left), right)
        pair, at, which = np.unique(keys, return_index=True, return_inverse=True)
        count = self.lookup("two", left[at], pair, 1)[which, 0]
        p = interpolated(count, context, m.pair_discounts, p)
        if m.order == 3:
            # the context of a token is the pair of the token before it
            context = np.roll(self.lookup("context-three", right[at], pair, 4)[which], 1, axis=0)
            context[begin] = 0
            keys = triple_keys(as_first(before_left(left, lengths)), keys)
            triple, at, which = np.unique(keys, return_index=True, return_inverse=True)
            count = self.lookup("three", left[at], triple, 1)[which, 0]
            p = interpolated(count, context, m.top_discounts, p)
        return seen, base, np.log10(p)


def interpolated(count: np.ndarray, context: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """Probabilities of one level from those of the level below; where the context was never seen, those."""
    d = np.array([0.0, *d])
    total = np.maximum(context[:, 0], 1)
    p = np.maximum(count - d[np.minimum(count, 3)], 0.0) / total + (context[:, 1:] @ d[1:]) / total * lower
    return np.where(context[:, 0] > 0, p, lower)


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, then n_tokens, n_known, base_score, score (log10) and perplexity of every row's whole text.

    Null counts as empty (one token, the end).  Repeated rows give repeated results; an empty table gives an empty one.
    """
    src = docs.select(*keep, text_or_empty(text_col).cast("binary").alias("_text"))
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def score(batches):
        cache, reader = WordHashes(), Reader(model)
        for batch in batches:
            texts, n_keep = batch.column(len(keep)).to_pylist(), len(keep)
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= 4_000_000):
                    size += len(texts[end])
                    end += 1
                left, right, lengths = tokens(texts[at:end], cache)
                seen, base, logp = reader.score(left, right, lengths)
                first = np.cumsum(lengths) - lengths
                total = np.add.reduceat(logp, first)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(at, end - at) for k in range(n_keep)], pa.array(lengths),
                     pa.array(np.add.reduceat((seen > 0).astype(np.int64), first)),
                     pa.array(np.add.reduceat(base, first)), pa.array(total), pa.array(10.0 ** np.minimum(-total / lengths, 300.0))],
                    names=[*keep, "n_tokens", "n_known", "base_score", "score", "perplexity"])
                at = end

    return src.mapInArrow(score, ddl + ", n_tokens long, n_known long, base_score double, score double, perplexity double")
