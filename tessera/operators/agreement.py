"""Agreement of sets and labels: Jaccard, Dice, cross-tables, purity, pair rates, stability, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shares(a: DataFrame, b: DataFrame, by: list[str], item: str) -> DataFrame:
    """For each group the sizes of both sets and of what they share; sets need not fit in one row."""
    both = a.select(*by, item, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(*by, item, F.lit(0), F.lit(1)))
    items = both.groupBy(*by, item).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return items.groupBy(*by).agg(F.sum("x").alias("n_left"), F.sum("y").alias("n_right"), F.sum(F.col("x") * F.col("y")).alias("n_both"))


def jaccard(a: DataFrame, b: DataFrame, by: list[str], item: str) -> DataFrame:
    """Two empty sets have similarity 1."""
    s = _shares(a, b, by, item)
    return s.withColumn("jaccard", F.round(F.coalesce(F.try_divide("n_both", F.col("n_left") + F.col("n_right") - F.col("n_both")), F.lit(1.0)), 9))


def dice(a: DataFrame, b: DataFrame, by: list[str], item: str) -> DataFrame:
    s = _shares(a, b, by, item)
    return s.withColumn("dice", F.round(F.coalesce(F.try_divide(2 * F.col("n_both"), F.col("n_left") + F.col("n_right")), F.lit(1.0)), 9))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def purity(df: DataFrame, sig: str, producer: str) -> DataFrame:
    """How well a signature tells its producer: weighted purity, majority baseline, lift, share of signatures seen once."""
    cells = df.groupBy(sig, producer).agg(F.count("*").alias("n"))
    by_sig = cells.groupBy(sig).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    by_producer = cells.groupBy(producer).agg(F.sum("n").alias("n")).agg(F.max("n").alias("majority"))
    out = by_sig.agg(F.sum("most").alias("m"), F.sum("n").alias("t"), F.count_if(F.col("n") == 1).alias("once"), F.count("*").alias("k")).crossJoin(F.broadcast(by_producer))  # one row each
    p, b = F.col("m") / F.col("t"), F.col("majority") / F.col("t")
    return out.select(F.col("k").alias("signatures"), F.round(p, 9).alias("purity"), F.round(b, 9).alias("baseline"), F.round(F.try_divide(p - b, 1 - b), 9).alias("lift"), F.round(F.col("once") / F.col("k"), 9).alias("singletons"))


def pair_rate(a: Column, b: Column) -> Column:
    """Share of rows where both are equal; null equals null."""
    return F.round(F.avg(a.eqNullSafe(b).cast("double")), 9)


def set_hash(c: Column) -> Column:
    """sha256 of the distinct values, sorted, each with a line break after it."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set(c.cast("string"))), "\n"), F.lit("\n")).cast("binary"), 256)


def stability(df: DataFrame, family: str, member: str, item: str) -> DataFrame:
    """For each family its members, distinct item sets, and whether all members have one set."""
    members = df.groupBy(family, member).agg(set_hash(F.col(item)).alias("h"))
    return members.groupBy(family).agg(F.count("*").alias("members"), F.countDistinct("h").alias("profiles"), (F.countDistinct("h") == 1).alias("stable"))


def symmetric_coverage(left: Column, left_all: Column, right: Column, right_all: Column) -> Column:
    """Harmonic mean of both sides' coverage."""
    l, r = F.try_divide(left, left_all), F.try_divide(right, right_all)
    return F.round(F.try_divide(2 * l * r, l + r), 9)
