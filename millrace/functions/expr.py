"""Expressions that Spark lacks: exact group quantiles that scale, null-keeping clip, text of fixed places, entropy, distinct with nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600.0


def seconds_between(start: str, end: str) -> Column:
    """Whole seconds from ``start`` to ``end``, cut towards zero."""
    return F.expr(f"timestampdiff(SECOND, {start}, {end})")


def micro_seconds_between(start: str, end: str) -> Column:
    """Seconds with microseconds as a double."""
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / F.lit(1e6)


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def fixed(c: Column, places: int) -> Column:
    """A number from zero up as text with ``places`` decimals, as C's printf rounds: by its exact binary value, exact ties to even.

    Java's formats and Spark's round take its shortest decimals and go half up: 73440 s are 0.85 days, whose double lies below 0.85.
    """
    unit, bits = 10 ** places, F.lit(float(1 << 26))
    whole = F.floor(c)
    part = c - whole
    high = F.floor(part * bits) / bits  # few enough bits that its product with the unit is exact, and so is that of the rest near a tie
    down = F.floor(high * F.lit(float(unit)))
    over = (high * F.lit(float(unit)) - down - F.lit(0.5)) + (part - high) * F.lit(float(unit))
    units = whole * unit + down
    units = units + F.when((over > 0) | ((over == 0) & (units % 2 == 1)), 1).otherwise(0)
    rest = units % unit
    return F.concat(((units - rest) / unit).cast("long").cast("string"), F.lit("."), F.lpad(rest.cast("string"), places, "0"))


def distinct_with_null(name: str) -> Column:
    """Distinct values where null counts as one."""
    return F.count_distinct(name) + F.max(F.col(name).isNull().cast("int"))


def variant_id(sequence: Column) -> Column:
    """First twelve hex digits of the MD5 of the activities joined by ``|``; 'empty' for no activity."""
    return F.when(F.size(sequence) > 0, F.substring(F.md5(F.concat_ws("|", sequence).cast("binary")), 1, 12)).otherwise(F.lit("empty"))


def map_value(mapping: dict[str, str], key: Column, default: str) -> Column:
    """Look a key up in a small fixed mapping."""
    if not mapping:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(key.isNull(), F.lit(default)).otherwise(F.coalesce(F.try_element_at(pairs, key), F.lit(default)))


def cumulative_counts(df: DataFrame, keys: list[str], value: str, fine: bool = True) -> DataFrame:
    """keys, _v, _n, _hi, _total: every value of a group with its count, the rows up to it and the rows of the group.  Nulls are left out.

    ``fine``: values are cut into ranges of about one percent, ranges are cumulated by group and values within their range, so
    a large group spreads over many tasks; otherwise a group's distinct values are cumulated by one window, which spills.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    by, upto = Window.partitionBy(*keys), lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if not fine:
        return counted.withColumns({"_hi": F.sum("_n").over(upto(by.orderBy("_v"))), "_total": F.sum("_n").over(by)})
    size = F.floor(F.log2(F.abs("_v") + 1) * 64)
    counted = counted.withColumn("_b", (F.signum("_v") * size).cast("int"))
    ranges = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    ranges = ranges.select(*keys, "_b", (F.sum("_m").over(upto(by.orderBy("_b"))) - F.col("_m")).alias("_low"), F.sum("_m").over(by).alias("_total"))
    return with_group(counted, ranges, [*keys, "_b"], "inner").withColumn(
        "_hi", F.sum("_n").over(upto(Window.partitionBy(*keys, "_b").orderBy("_v"))) + F.col("_low")).drop("_b", "_low")


def with_places(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counted`` (rows of a group with their count ``_n``) with _hi, the group's rows up to this one in order of ``value``, and
    _total, all that have a value.  A null value has no place.  Windows of the group's rows, which spill.
    """
    by, here = Window.partitionBy(*keys), F.when(F.col(value).isNotNull(), F.col("_n"))
    upto = by.orderBy(F.asc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumns({"_hi": F.sum(here).over(upto), "_total": F.sum(here).over(by)})


def value_at(rank: Column, value: str) -> Column:
    """The value at a 0-based rank: aggregate expression over rows of with_places."""
    return F.max(F.when((rank >= F.col("_hi") - F.col("_n")) & (rank < F.col("_hi")) & F.col(value).isNotNull(), F.col(value)))


def group_quantiles(df: DataFrame, keys: list[str], value: str, fine: bool = False, **wanted: tuple[str, float]) -> DataFrame:
    """Exact quantiles by group: name=("nearest" | "linear", q), and from the same pass name=("count", 0) and ("max", 0).  Nulls are left out.

    Values are counted by (group, value) first, so a group holds its distinct values only, sorted and cumulated by a
    window that spills; no list or map of a group's values is built in memory.  ``fine`` is for values with as many
    distinct ones as rows (microseconds): they are cut into ranges of about one percent, ranges are cumulated by group and
    values within their range, so a large group spreads over many tasks.
    """
    cum = cumulative_counts(df, keys, value, fine)

    def at(rank: Column) -> Column:  # value at a 0-based rank
        return F.max(F.when((rank >= F.col("_hi") - F.col("_n")) & (rank < F.col("_hi")), F.col("_v")))

    place = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    aggs = []
    for name, (kind, q) in wanted.items():
        if kind == "count":
            aggs.append(F.max("_total").alias(name))
        elif kind == "max":
            aggs.append(F.max("_v").alias(name))
        elif kind == "nearest":
            aggs.append(at(F.round(place(q)).cast("long")).cast("double").alias(name))
        else:
            aggs += [at(F.floor(place(q))).cast("double").alias(f"_lo_{name}"), at(F.ceil(place(q))).cast("double").alias(f"_up_{name}"),
                     F.max(place(q) - F.floor(place(q))).alias(f"_f_{name}")]
    out = cum.groupBy(*keys).agg(*aggs)
    for name, (kind, _) in wanted.items():
        if kind == "linear":
            lo, up = F.col(f"_lo_{name}"), F.col(f"_up_{name}")
            out = out.withColumn(name, lo + (up - lo) * F.col(f"_f_{name}")).drop(f"_lo_{name}", f"_up_{name}", f"_f_{name}")
    return out


def with_group(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join on group keys; the right side's keys are dropped."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def entropy_of_counts(counted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Shannon entropy by group over log2 of its number of items, from a row an item with its count ``_c``; 0 for a single item."""
    total = counted.groupBy(*keys).agg(F.sum("_c").alias("_t"), F.sum(F.col("_c") * F.log2("_c")).alias("_s"), F.count("*").alias("_k"))
    # -sum p log2 p = log2 t - (sum c log2 c) / t
    value = (F.log2("_t") - F.col("_s") / F.col("_t")) / F.log2("_k")
    return total.select(*keys, F.when(F.col("_k") > 1, value).otherwise(F.lit(0.0)).alias(name))


def normalised_entropy(df: DataFrame, keys: list[str], item: str, name: str) -> DataFrame:
    """Entropy of the values of ``item`` by group.  Nulls are left out."""
    return entropy_of_counts(df.filter(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("_c")), keys, name)
