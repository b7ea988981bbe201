"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes when the same line, or one within ``edits`` insertions, deletions or substitutions, stands earlier
(smaller doc_id, or the same document and an earlier line).  Lines under ``near_chars`` characters go only for an equal
one ("item 1" and "item 2" are different lines); blank lines stay, they part paragraphs.

1. Distinct lines with their first places (partial aggregation first: a very common line is a row a task).
2. Every line is cut into edits + 1 even segments.  Two lines within the threshold share one of them at nearly the same
   place, so a line is indexed by (length, segment number, segment) and probes the indexes of its own and shorter
   lengths with the substrings that the multi-match rule leaves.
   Where more than ``HOT`` lines (and more than they have characters) share a segment, its pairs are not formed: at one edit
   these lines meet exactly, by what is left of them without one character (see ``_hot_pairs``).
3. Candidate pairs whose letter counts allow the threshold, without repeats, are verified by a bit-parallel edit distance over the band of 2 * edits + 1
   diagonals, held in one 64-bit word however long the lines are.
4. Places to remove are joined back to the documents by id; the text is rebuilt from the lines that stay.

Scale: lines travel as two hashes, a place and their segment keys; joins are by hash from written tables, so AQE splits
skewed ones.  Texts of candidates only are fetched for verification (a Bloom bitmap of bounded size holds the others
back) and documents are shuffled once, to meet the places to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bloom import bitmap, cells_for, looked_up
from millrace.llm.common import dropped, partitions, staged, text_or_empty


def _segment(n: str, i: int, parts: int) -> tuple[str, str]:
    """Start (0-based) and length of segment ``i`` of a line of ``n`` characters, as SQL."""
    start = f"cast(({n}) * {i} div {parts} as int)"
    stop = f"cast(({n}) * {i + 1} div {parts} as int)"
    return start, f"({stop} - {start})"


#: Lines that may share a segment before they meet in another way.
HOT = 256

#: Groups of characters whose counts tell lines apart (any groups are sound; these are common in Latin scripts).
COUNTED = ("ea", "tn", "oirs")


def letter_counts() -> Column:
    """Counts of the groups in column ``line``, each modulo 16, packed into one number."""
    out = F.lit(0)
    for k, letters in enumerate(COUNTED):
        count = F.col("n") - F.length(F.translate("line", letters, ""))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15)), 4 * k))
    return out


def may_be_close(a: str, b: str, edits: int) -> Column:
    """No pair within the threshold fails this: an edit changes the counts by two in all, and modulo only hides changes."""
    total = F.lit(0)
    for k in range(len(COUNTED)):
        x, y = (F.shiftright(F.col(c), 4 * k).bitwiseAND(F.lit(15)) for c in (a, b))
        total = total + F.least((x - y).bitwiseAND(F.lit(15)), (y - x).bitwiseAND(F.lit(15)))
    return total <= 2 * edits


def segment_keys(edits: int) -> tuple[list[Column], list[Column]]:
    """Keys of column ``line`` (of ``n`` characters): those of its own segments, and further ones to probe.

    Under its own keys a line is found by lines as long or longer; under all of them it finds lines as long or shorter.
    """
    own, more = [], []
    for shorter in range(edits + 1):
        m = f"(n - {shorter})"
        for i in range(edits + 1):
            start, size = _segment(m, i, edits + 1)
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for shift in range(low, high + 1):
                key = F.expr(f"xxhash64({i}, {m}, substring(line, {start} + {1 + shift}, {size}))")
                (own if shorter == shift == 0 else more).append(key)
    return own, more


def _hot_pairs(each: DataFrame, lines: DataFrame, hot: DataFrame, name: list[Column], n_keys: int) -> DataFrame:
    """Pairs (k1, k2, m1, m2) for the lines that have a hot segment, at one edit, without forming the pairs of a segment.

    Two lines of one length are within one edit if and only if they are equal without the character at one common place: all
    lines that agree there are within one edit of each other, so each is paired with the earliest of them only.  Two lines whose
    lengths differ by one are if and only if the longer is the shorter without one character: found by the shorter's name.
    """
    own = lines.select("k1", "k2", F.explode(F.array_compact(F.array_distinct(F.array(*[F.col(f"s{i}") for i in range(n_keys)])))).alias("key"))
    ids = staged(own.join(hot, "key", "left_semi").select("k1", "k2").distinct(), "hot-ids")
    found = each.select(*name, "line").join(ids, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("line").alias("line"))
    texts = staged(found.join(lines.select("k1", "k2", "first"), ["k1", "k2"]), "hot-lines")
    rest = F.concat(F.expr("substring(line, 1, place - 1)"), F.expr("substring(line, place + 1)"))
    cut = (texts.select("k1", "k2", "first", "line", F.explode(F.sequence(F.lit(1), F.length("line"))).alias("place"))
           .select("k1", "k2", "first", "place", F.xxhash64(rest).alias("r1"), F.xxhash64(F.lit(7), rest).alias("r2")))
    cut = staged(cut, "hot-rests")
    by = ["place", "r1", "r2"]
    least = cut.groupBy(*by).agg(F.min(F.struct("first", "k1", "k2")).alias("m"), F.count("*").alias("n")).filter("n > 1")
    same = cut.join(least, by).select("k1", "k2", F.col("m.k1").alias("m1"), F.col("m.k2").alias("m2"))
    shorter = lines.filter("s0 is not null").select(F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    less = cut.join(shorter, ["r1", "r2"]).select("k1", "k2", F.col("r1").alias("m1"), F.col("r2").alias("m2"))
    return same.unionByName(less).filter("k1 <> m1 or k2 <> m2").distinct()


def banded_distance(x: str, y: str, edits: int) -> Column:
    """Edit distance of two string columns whose lengths differ by ``edits`` at most; exact up to ``edits``, larger beyond.

    Bit b of a word stands for row j - edits + b of the dynamic programme in column j (rows: the shorter string, of
    ``edits`` characters at least); words hold the vertical differences of +1 and -1.
    """
    width = 2 * edits + 1
    ones, top = (1 << width) - 1, 1 << (width - 1)
    a, b = (F.split(F.when(F.length(x) <= F.length(y), F.col(s)).otherwise(F.col(t)), "") for s, t in ((x, y), (y, x)))
    both = F.struct(a.alias("a"), b.alias("b"))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(state: Column, j: Column, p: Column) -> Column:
        match = F.lit(0).cast("long")
        for k in range(width):  # array positions are 0-based: row r is a[r - 1]
            same = F.coalesce(F.get(p["a"], j - edits + (k - 1)) == F.get(p["b"], j - 1), F.lit(False))
            match = match.bitwiseOR(F.when(same, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        vp, vn = state["vp"], state["vn"]

        def with_match(m):
            def with_d0(d0):
                hp = vn.bitwiseOR(F.bitwise_not(vp.bitwiseOR(d0)).bitwiseAND(F.lit(ones).cast("long")))
                hn = vp.bitwiseAND(d0)

                def with_h(h):
                    right = F.shiftrightunsigned(d0, 1)
                    row = F.size(p["a"]) - j + edits  # bit of the last row
                    last = F.pow(F.lit(2.0), row.cast("double")).cast("long")
                    along = (F.when(h["p"].bitwiseAND(last) != 0, 1).when(h["n"].bitwiseAND(last) != 0, -1).otherwise(0))
                    down = F.when(d0.bitwiseAND(F.lit(top).cast("long")) != 0, 0).otherwise(1)
                    return F.struct(
                        h["n"].bitwiseOR(F.bitwise_not(right.bitwiseOR(h["p"])).bitwiseAND(F.lit(ones).cast("long"))).alias("vp"),
                        right.bitwiseAND(h["p"]).alias("vn"),
                        (state["d"] + F.when(j + edits <= F.size(p["a"]), down).otherwise(along)).cast("int").alias("d"))

                return let(F.struct(hp.alias("p"), hn.alias("n")), with_h)

            x_ = m.bitwiseOR(vn)
            d0 = ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x_).bitwiseAND(F.lit(ones).cast("long"))
            return let(d0, with_d0)

        return let(match, with_match)

    start = F.struct(F.lit(ones ^ ((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).cast("int").alias("d"))
    return let(both, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p["b"])), start, lambda s, j: step(s, j, p), lambda s: s["d"]))


def repeated_lines(docs: DataFrame, edits: int = 1, near_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, places): per document (id and hash of its text) the numbers of the lines to remove.

    A line goes for any earlier line within ``edits`` edits, also for one that goes itself: chains are cut to their first line.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    each = (base.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("n", F.length("line")))
    name = [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), F.col("line")).alias("k2")]
    place = F.struct("doc_id", "h", "pos")
    own, more = segment_keys(edits)
    long_enough = F.col("n") >= max(near_chars, edits + 1)
    keys = [F.when(long_enough, k).alias(f"s{i}") for i, k in enumerate(own + more)]
    keyed = each.select(*name, place.alias("place"), "n", letter_counts().alias("c"), *keys)
    lines = staged(keyed.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.count("*").alias("times"), F.max("c").alias("c"), F.max("n").alias("n"),
                                                 *[F.max(f"s{i}").alias(f"s{i}") for i in range(len(keys))]), "lines")

    def exploded(n, side):
        return lines.select(F.explode(F.array_compact(F.array_distinct(F.array(*[F.col(f"s{i}") for i in range(n)])))).alias("key"),
                            *[F.col(x).alias(f"{side}{y}") for x, y in (("k1", "1"), ("k2", "2"), ("c", "c"), ("n", "n"))])

    indexed, probing = exploded(len(own), "a"), exploded(len(keys), "b")
    hot = None
    if edits == 1:
        hot = indexed.groupBy("key").agg(F.count("*").alias("times"), F.max("an").alias("an")).filter((F.col("times") > HOT) & (F.col("times") > F.col("an")))
        hot = staged(hot.select("key"), "hot-segments")
        if hot.isEmpty():
            hot = None
        else:
            indexed = indexed.join(hot, "key", "left_anti")
    flip = F.struct("a1", "a2") > F.struct("b1", "b2")
    pairs = (probing.join(indexed, "key").filter("a1 <> b1 or a2 <> b2").filter(may_be_close("ac", "bc", edits))
             .select(*[F.when(flip, F.col(s)).otherwise(F.col(t)).alias(c)
                       for c, s, t in (("a1", "b1", "a1"), ("a2", "b2", "a2"), ("b1", "a1", "b1"), ("b2", "a2", "b2"))]).distinct())
    if hot is not None:
        more = _hot_pairs(each, lines, hot, name, len(keys))
        a, b = F.struct("k1", "k2"), F.struct(F.col("m1").alias("k1"), F.col("m2").alias("k2"))
        low, high = F.least(a, b), F.greatest(a, b)
        pairs = pairs.unionByName(more.select(*[x[y].alias(z) for x, y, z in (
            (low, "k1", "a1"), (low, "k2", "a2"), (high, "k1", "b1"), (high, "k2", "b2"))])).distinct()
    pairs = staged(pairs, "line-pairs")
    ids = pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionByName(pairs.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"))).distinct()
    ids = staged(ids, "line-ids")
    # Only lines that may be candidates travel: a Bloom bitmap of bounded size is looked up first.
    n_cells = cells_for(ids.count())
    cell = F.pmod(F.xxhash64("k2", "k1"), F.lit(n_cells))
    bits = staged(bitmap(ids.select(cell.alias("cell")).distinct()), "line-bloom")
    maybe = looked_up(each.select(*name, "line"), bits, cell, "maybe").filter("maybe").drop("maybe")
    # an inner join: a semi join would be pushed below the bitmap
    texts = maybe.join(ids, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("line").alias("line"))
    texts = staged(texts.join(lines.select("k1", "k2", "first"), ["k1", "k2"]), "line-texts")

    def side(s):
        return texts.select(*[F.col(c).alias(f"{s}{d}") for c, d in (("k1", 1), ("k2", 2), ("line", "x"), ("first", "f"))])

    close = (pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
             .filter(F.abs(F.length("ax") - F.length("bx")) <= edits)
             .repartition(partitions(docs.sparkSession))  # few bytes, much work
             .filter(banded_distance("ax", "bx", edits) <= edits))
    later = F.col("af") > F.col("bf")
    gone = close.select(F.when(later, F.col("a1")).otherwise(F.col("b1")).alias("k1"),
                        F.when(later, F.col("a2")).otherwise(F.col("b2")).alias("k2")).distinct().withColumn("gone", F.lit(True))
    verdict = (lines.select("k1", "k2", "first", "times").join(gone, ["k1", "k2"], "left").filter("times > 1 or gone")
               .select("k1", "k2", F.when(F.col("gone").isNull(), F.col("first")).alias("stays")))
    verdict = staged(verdict, "line-verdicts")
    dropped(lines)
    return (each.select(*name, "doc_id", "h", "pos").join(verdict, ["k1", "k2"])
            .filter(~(place.eqNullSafe(F.col("stays"))))
            .groupBy("doc_id", "h").agg(F.collect_set("pos").alias("places")))


def dedup_lines(docs: DataFrame, edits: int = 1, near_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines cut out of the text, plus n_lines and n_removed.

    Lines are split at \\n; blank ones always stay, those under ``near_chars`` characters go only for an equal one.  Null counts as empty (one empty line).
    Rows that repeat an id with the same text are one document for this purpose and share its verdict; with different
    texts they are documents in order of a hash of their texts; a null id comes first.  Columns of ``docs`` named
    n_lines or n_removed are replaced.  An empty table gives an empty result.
    """
    gone = repeated_lines(docs, edits, near_chars, id_col, text_col).select(
        F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("places").alias("_places"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = docs.select(*columns).withColumn(text_col, text_or_empty(text_col)).withColumn("_hash", F.xxhash64(text_col))
    base = base.withColumn("_key", F.coalesce(F.col(id_col).cast("string"), F.lit("-")))
    gone = gone.withColumn("_gkey", F.coalesce(F.col("_id").cast("string"), F.lit("-")))
    out = base.join(gone, (F.col("_key") == F.col("_gkey")) & (F.col("_hash") == F.col("_h")), "left")
    lines = F.split(text_col, "\n")
    kept = F.get(F.transform(F.array(lines), lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_places")), lambda i: F.get(ls, i)), "\n")), F.lit(0))
    return (out.withColumn("n_lines", F.size(lines).cast("long"))
            .withColumn("n_removed", F.when(F.col("_places").isNull(), 0).otherwise(F.size("_places")).cast("long"))
            .withColumn(text_col, F.when(F.col("_places").isNull(), F.col(text_col)).otherwise(kept))
            .select(*columns, "n_lines", "n_removed"))
