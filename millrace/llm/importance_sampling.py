"""Target-distribution importance resampling: documents are drawn by how much more likely their n-grams are in the target texts.

Identical texts are collapsed first, by grouping the full text: the buckets of a text's n-grams are computed once and written,
its weight is computed once, and what it adds to the corpus counts is multiplied by its number of copies.  Weights go back
to the documents by the digest of their text, and only then comes the noise that is a document's own.  The highest scores are
drawn (Gumbel noise added to log weights: a draw without replacement).

Scale: a full text shuffles once, after a partial aggregation that leaves one row a text and task, so a text that a third of all
rows share is one row a task.  Corpus counts are ``buckets`` rows whatever the corpus.  Going back, texts that hold over 1/256
of all rows, of which there are fewer than 256, are broadcast, and all others join by digest, so no key of that join holds more than
1/256 of the rows.  Ranks are global ones by range (``functions.ranks``): no task sorts all scores.

Nulls: a null text has no words, a null id counts as the empty string in the noise and stands before all others among ties.
Rows that repeat an id each stand for themselves (their noise is the same).  A table without eligible rows draws none; an empty table
gives an empty result; an empty target gives every bucket a gain by the corpus alone.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ranks import global_rank
from millrace.llm.common import staged, text_or_empty

#: Lower-case A-Z only; words are runs of digits, letters and characters beyond ASCII.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts with more than one in HOT rows go back by broadcast: fewer than HOT of them.
HOT = 256
TWO_32 = 4294967296.0


@dataclass(frozen=True)
class Resampling:
    """Longest n-gram, buckets of their hashes, words that a drawn document needs, share drawn in percent, seed of the noise."""

    longest: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: str = "2024"


def words(text: Column) -> Column:
    """Words of a text, left to right."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")


def bucket_list(w: Column, how: Resampling) -> Column:
    """Buckets of all runs of 1 to ``longest`` consecutive words joined by a space, repeats kept."""
    def bucket(s: Column) -> Column:
        return (F.crc32(s.cast("binary")) % F.lit(how.buckets)).cast("int")

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda at: bucket(F.array_join(F.slice(w, at, n), " ")))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<int>"))

    one = F.transform(w, bucket)
    return F.concat(one, *[runs(n) for n in range(2, how.longest + 1)]) if how.longest > 1 else one


def collapsed(texts: DataFrame, how: Resampling) -> DataFrame:
    """One row for each different text of ``texts`` (column text, never null): digest, copies, n_words, features (buckets)."""
    groups = texts.groupBy("text").agg(F.count("*").alias("copies"))
    split = groups.select(F.sha2("text", 256).alias("digest"), "copies", words(F.col("text")).alias("words"))
    return split.select("digest", "copies", F.size("words").cast("long").alias("n_words"), bucket_list(F.col("words"), how).alias("features"))


def bucket_counts(groups: DataFrame, name: str) -> DataFrame:
    """bucket and ``name``: features in it, each as often as its text occurs; ``buckets`` rows at most."""
    return groups.select("copies", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias(name))


def gains(corpus: DataFrame, target: DataFrame, how: Resampling) -> DataFrame:
    """One row with ``gains``: an array of the gain of every bucket, floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))).

    corpus: bucket, s; target: bucket, t; B buckets.
    """
    every = corpus.sparkSession.range(how.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus, "bucket", "left").join(target, "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.sum("s").cast("double").alias("_s"), F.sum("t").cast("double").alias("_t"))
    b = F.lit(float(how.buckets))
    ratio = ((F.col("t") + 1.0) * (F.col("_s") + b)) / ((F.col("s") + 1.0) * (F.col("_t") + b))
    gain = F.floor(F.lit(1000.0) * F.log(ratio))
    row = both.crossJoin(F.broadcast(sums)).select(F.struct("bucket", gain.alias("gain")).alias("g"))  # sums: one row
    return row.agg(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["gain"]).alias("gains"))


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first eight hex digits of sha256(``seed:doc_id``)."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(TWO_32))))


def weighted(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``; ``target`` needs the column ``text_col``."""
    ids = staged(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("digest")), "resampling-ids")
    groups = staged(collapsed(docs.select(text_or_empty(text_col).alias("text")), how), "resampling-texts")
    wanted = collapsed(target.select(text_or_empty(text_col).alias("text")), how)
    table = gains(bucket_counts(groups, "s"), bucket_counts(wanted, "t"), how)
    total = F.aggregate("features", F.lit(0).cast("long"), lambda acc, b: acc + F.get("gains", b))
    weights = staged(groups.crossJoin(F.broadcast(table)).select(  # table: one row of ``buckets`` numbers
        "digest", "copies", "n_words", F.size("features").cast("long").alias("n_features"), total.alias("weight")), "resampling-weights")

    rows = ids.count()
    common = weights.filter(F.col("copies") * HOT > F.lit(rows))  # fewer than HOT rows
    hot = common.select("digest", F.struct("n_words", "n_features", "weight").alias("found"))
    known = ids.join(F.broadcast(hot), "digest", "left")
    rare = weights.filter(F.col("copies") * HOT <= F.lit(rows)).drop("copies")
    return (known.filter("found is not null").select("doc_id", "found.*")
            .unionByName(known.filter("found is null").drop("found").join(rare, "digest").drop("digest")))


def resample(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``; rank is null for those not drawn.

    Of the N rows with ``min_words`` words or more, floor(percent * N / 100) with the highest scores are drawn, ties to the smaller id.
    """
    found = weighted(docs, target, how, id_col, text_col)
    scored = staged(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), how.seed)), "resampling-scores")
    fit = F.col("n_words") >= how.min_words
    ranked = global_rank(scored.filter(fit), [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")], "rank")
    drawn = scored.filter(fit).count() * how.percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    others = scored.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(others)
