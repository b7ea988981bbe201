"""MinHash near-dedup with SuperMinHash signatures, banding, verification on full sets and union-find grouping.

1. Every text becomes its set of word shingles; documents with the same set form a class, so copies are never paired.
2. SuperMinHash: element i places the values r_ij + j (j = 0, 1, ...) at the positions of its own random permutation;
   the signature holds the smallest value at each position.  Steps end when no position can improve.
3. Bands of a signature are buckets.  A bucket links each class to one centre, chosen by a hash of bucket and class, so a
   class meets different centres in its buckets; links are confirmed on the full shingle sets.
4. Classes that hang together by buckets are a family.  Where a family still has several components, the members of all
   but its largest are compared with every member whose size allows a link: in blocks of ``BLOCK`` members of one range
   of sizes, each an inverted index of shingles that the family's members of this and the adjacent ranges stream past.
   So every candidate pair is inside one component or compared on full sets; no pair becomes a row unless it links two
   components.  No cap anywhere.

Scale: text is read twice and shuffled once (only where a full set is needed); bucket rows are 24 bytes; a hot
bucket costs its size, not its square, while its members are linked; joins on buckets and classes start from
written tables, so AQE can split skewed ones.  Links and components stay in tables, never on the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import U64, WordHashes, dropped, mixed, partitions, shingle_hashes, signed, staged, text_or_empty, words_of
from millrace.llm.components import connected_components

#: 96 positions in 24 bands of 4: a pair at 0.85 is missed with probability 2e-8, one at 0.8 with 3e-6.
BANDS, ROWS = 24, 4
#: Members of smaller components that are compared at once.
BLOCK = 256


def superminhash(elements: np.ndarray, sizes: np.ndarray, m: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    """Signatures (one row a set) of sets given as one flat array of distinct 64-bit elements and the sets' sizes."""
    sets = len(sizes)
    out = np.full(sets * m, np.inf)
    owner = np.repeat(np.arange(sets), sizes)
    state = mixed(elements + U64(seed))
    order = np.empty((len(elements), m), np.uint8 if m <= 256 else np.uint16)
    order[:] = np.arange(m)
    rows = np.arange(len(elements))
    for j in range(m):
        worst = out.reshape(sets, m).max(axis=1)  # values of step j are j or more
        rows = rows[worst[owner[rows]] > j]
        if not len(rows):
            break
        state[rows] = x = mixed(state[rows] + U64(0x9E3779B97F4A7C15))
        value = (x >> U64(11)).astype(np.float64) * 2.0 ** -53 + j
        k = j + (mixed(x ^ U64(0xD1B54A32D192ED03)) % U64(m - j)).astype(np.int64)
        at = order[rows, k].copy()
        order[rows, k] = order[rows, j]
        order[rows, j] = at
        np.minimum.at(out, owner[rows] * m + at, value)
    return out.reshape(sets, m)


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash a band; equal only for equal rows of the band (up to hash collisions)."""
    bits = np.ascontiguousarray(signatures).view(U64).reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), bits.shape[:2]).copy()
    for r in range(rows):
        out = mixed(out ^ bits[:, :, r]) * U64(0x9E3779B97F4A7C15)
    return mixed(out)


def _sets(texts: list[bytes], width: int, cache: WordHashes) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(cache.of(words_of(t)), width)) for t in texts]


def _class_id(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, bands) of every row; class and bands are null for texts without words."""
    def sign(batches):
        cache = WordHashes()
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= 800_000):
                    size += len(texts[end])
                    end += 1
                sets = _sets(texts[at:end], width, cache)
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                bands = np.zeros((len(sets), BANDS), U64)
                if len(some):
                    bands[some] = band_hashes(superminhash(np.concatenate([sets[k] for k in some]), sizes[some]))
                full = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(signed(bands).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), pa.array(sizes, pa.int64()), pa.array([_class_id(s) for s in sets], pa.binary()), full],
                    names=["doc_id", "n_shingles", "class", "bands"])
                at = end

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return src.mapInArrow(sign, "doc_id long, n_shingles long, class binary, bands array<long>")


def _full_sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(class, members) of the classes in ``needed`` (class, rep): their sorted shingle hashes as bytes."""
    def build(batches):
        cache = WordHashes()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 200):
                sets = _sets(texts[at:at + 200], width, cache)
                yield pa.RecordBatch.from_arrays([pa.array([_class_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["class", "members"])

    reps = needed.select(F.col("rep").alias("doc_id")).distinct()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return src.join(reps, "doc_id", "left_semi").select("text").mapInArrow(build, "class binary, members binary").filter("class is not null")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * |intersection| >= percent * |union|."""
    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.sum(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("class").alias("b"), F.col("members").alias("y")), "b")
            .join(sets.select(F.col("class").alias("a"), F.col("members").alias("x")), "a")
            .select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary"))


def _size_bin(percent: int) -> Column:
    """Bins of set sizes (column ``n``) so wide that linked sets, whose sizes differ by the threshold's share at most, lie in the same or in adjacent ones."""
    width = max(-math.log(min(percent, 100) / 100.0), 1e-9) * (1 + 1e-9) if percent > 0 else math.inf
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long")


def _links_across(families: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between different components of one family, as few as join them; None where no family is torn.

    Members of smaller components are the blocks, dealt by size of set; a member meets the blocks of sizes that allow a link only.
    """
    rooted = families.join(roots.withColumnRenamed("node", "class"), "class", "left").join(sets.select("class", "n"), "class")
    rooted = staged(rooted.withColumn("root", F.coalesce("root", "class")), "rooted")
    parts = rooted.groupBy("family", "root").agg(F.count("*").alias("n"))
    torn = (parts.groupBy("family").agg(F.sum("n").alias("members"), F.count("*").alias("parts"), F.max(F.struct("n", "root")).alias("most"))
            .filter("parts > 1 and members > 2")  # of two members the only pair is tested
            .select("family", F.col("most.root").alias("most")))
    torn = staged(torn, "torn")
    if torn.isEmpty():
        return None
    rows = staged(rooted.join(torn, "family").withColumn("bin", _size_bin(percent)), "torn-members")
    minor = rows.filter("root <> most")
    blocks = staged(minor.groupBy("family", "bin").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "blocks")
    own = minor.join(blocks, ["family", "bin"]).select(
        "family", "bin", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "class", "root")
    near = F.explode(F.array(*[F.col("bin") + k for k in (-1, 0, 1)])).alias("bin")
    every = (rows.select("family", near, "class", "root").join(blocks, ["family", "bin"])
             .select("family", "bin", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "class", "root"))
    both = own.unionByName(every).join(sets.select("class", "members"), "class").select("family", "bin", "block", "side", "class", "root", "members")
    both = both.repartition(partitions(rows.sparkSession), "family", "bin", "block").sortWithinPartitions("family", "bin", "block", "side")
    return both.mapInArrow(_compare(percent), "a binary, b binary")


def _compare(percent: int):
    def compare(batches):
        at, minors, index, joined = None, [], None, {}

        def find(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for batch in batches:
            out = []
            for family, bin_, block, side, class_, root, members in zip(*[c.to_pylist() for c in batch.columns]):
                if (family, bin_, block) != at:
                    at, minors, index, joined = (family, bin_, block), [], None, {}
                members = np.frombuffer(members, U64)
                if side == 0:
                    minors.append((class_, root, members))
                    continue
                if not minors:
                    continue
                if index is None:  # all minors of the block are here
                    sizes = np.array([len(m) for _, _, m in minors])
                    flat, owner = np.concatenate([m for _, _, m in minors]), np.repeat(np.arange(len(minors)), sizes)
                    order = np.argsort(flat, kind="stable")
                    flat, owner = flat[order], owner[order]
                    index = True
                low, high = np.searchsorted(flat, members, "left"), np.searchsorted(flat, members, "right")
                count = high - low
                total = int(count.sum())
                if not total:
                    continue
                hits = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)
                shared = np.bincount(owner[hits], minlength=len(minors))
                near = np.flatnonzero(100 * shared >= percent * (sizes + len(members) - shared))
                for k in near.tolist():
                    x, y = find(minors[k][1]), find(root)
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        out.append((minors[k][0], class_))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return compare


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Null counts as empty; texts without words have no shingles and are linked with nothing; shorter texts than
    ``width`` words are one shingle.  Rows that repeat an id share its verdict; a null id never names a component
    beside others.  Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed_docs = staged(signatures(docs, width), "signatures")
    classes = staged(signed_docs.filter("class is not null").groupBy("class")
                     .agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "classes")
    buckets = classes.select("class", F.explode("bands").alias("key"))
    rank = F.struct(F.xxhash64("key", "class").alias("h"), "class")
    groups = staged(buckets.groupBy("key").agg(F.count("*").alias("n"), F.min(rank).alias("low")).filter("n > 1")
                    .select("key", F.col("low.class").alias("centre")), "buckets")
    members = staged(buckets.join(groups, "key"), "members")

    def ordered(df, a, b):
        return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()

    tested = staged(ordered(members, "class", "centre"), "pairs")
    reps = members.select("class").distinct().join(classes.select("class", "rep"), "class")
    sets = staged(_full_sets(docs, reps, width).groupBy("class").agg(F.min("members").alias("members"))
                  .withColumn("n", (F.octet_length("members") / 8).cast("long")), "sets")
    links = staged(_confirmed(tested, sets, percent), "confirmed")
    roots = staged(connected_components(links), "roots")

    families = staged(connected_components(tested), "families").select(F.col("node").alias("class"), F.col("root").alias("family"))
    more = _links_across(families, roots, sets, percent)
    if more is not None:
        more = staged(more, "more-links")
        if not more.isEmpty():
            roots = staged(connected_components(links.unionByName(more)), "roots")
    dropped(members)

    named = (classes.select("class", "rep").join(roots.withColumnRenamed("node", "class"), "class", "left")
             .withColumn("root", F.coalesce("root", "class")))
    named = staged(named, "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    assigned = staged(named.join(least, "root").select("class", "component_id"), "assigned")
    return (signed_docs.drop("bands").join(assigned, "class", "left")
            .select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
