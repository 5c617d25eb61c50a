"""Joins, set operations and aggregates of record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---- joins -----------------------------------------------------------------------------------------------------


def positional_join(a: DataFrame, b: DataFrame, position: str, id_: str) -> DataFrame:
    """Rows of both tables by position; an id that differs, or a position that only one has, raises at run time."""
    right = b.select(*[F.col(c).alias(f"_b_{c}" if c in (position, id_) else c) for c in b.columns])
    both = a.withColumn("_a", F.lit(1)).join(right.withColumn("_b", F.lit(1)), F.col(position) == F.col(f"_b_{position}"), "full")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col(id_).eqNullSafe(F.col(f"_b_{id_}"))
    at = F.coalesce(F.col(position), F.col(f"_b_{position}")).cast("string")
    return both.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("POSITION_MISMATCH: "), at)))).drop("_a", "_b", f"_b_{position}", f"_b_{id_}")


def checked_join(records: DataFrame, views: DataFrame, id_: str, compared: list[str]) -> DataFrame:
    """(id, rule): records without view, with several, or whose compared columns differ from the view's."""
    v = views.groupBy(id_).agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_v_{c}") for c in compared])
    j = records.join(v, id_, "left")
    tests = [(F.col("_n").isNull(), "no_view"), (F.col("_n") > 1, "several_views"), *[((F.col("_n") == 1) & ~F.col(c).eqNullSafe(F.col(f"_v_{c}")), f"{c}_differs") for c in compared]]
    return j.select(F.col(id_), F.explode(F.array_compact(F.array(*[F.when(t, r) for t, r in tests]))).alias("rule"))


def crossed(items: DataFrame, authors: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Every author with every item, and the number of rows of ``done`` for it, 0 where there is none.

    A fully crossed design: ``authors`` is a handful of rows, which is checked; every pair is wanted.
    """
    n = authors.limit(1001).count()
    if n > 1000:
        raise ValueError("a crossed design has at most 1000 authors")
    counts = done.groupBy(*by).agg(F.count("*").alias("n"))
    return items.join(F.broadcast(authors)).join(counts, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def three_way(views: DataFrame, first: DataFrame, second: DataFrame, id_: str) -> DataFrame:
    """Rows of three tables that have one id."""
    return views.join(first, id_).join(second, id_)


def triggered(df: DataFrame, id_: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, id) of every rule that holds for a row."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules.items()]))
    return df.select(F.explode(held).alias("rule"), F.col(id_))


def with_default_status(expected: DataFrame, answers: DataFrame, by: list[str], status: str, failed: Column) -> DataFrame:
    """Every expected row with its answer's status; without one ``technical_invalid`` where the delivery failed, else ``not_delivered``."""
    return expected.join(answers, by, "left").withColumn(status, F.coalesce(status, F.when(failed, "technical_invalid").otherwise("not_delivered")))


def one_to_one(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(key, n_left, n_right) of keys that are not once on both sides."""
    both = left.select(*by, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*by, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*by).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).where("n_left <> 1 or n_right <> 1")


def first_present(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """The first key that is not blank as ``name``; a repeated one raises at run time."""
    df = df.withColumn(name, F.coalesce(*[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys]))
    again = df.groupBy(name).agg(F.count("*").alias("_n"))
    out = df.join(again, name)
    return out.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("DUPLICATE_RECORD: "), F.col(name))))).drop("_n")


# ---- sets ------------------------------------------------------------------------------------------------------


def set_loss(a: DataFrame, b: DataFrame, items: list[str]) -> DataFrame:
    """Numbers of distinct items: in both, lost (a only), gained (b only)."""
    both = a.select(*items, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*items, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy(*items).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("kept"), F.count_if(F.expr("a = 1 and b = 0")).alias("lost"), F.count_if(F.expr("a = 0 and b = 1")).alias("gained"))


def conflicts(df: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key, n_rows, n_versions, conflict): rows of one key and whether their digests differ."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows"), F.countDistinct(digest).alias("n_versions")).withColumn("conflict", F.col("n_versions") > 1)


def shared_by_all(df: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """(group, item): items that every member of the group has."""
    members = df.groupBy(group).agg(F.countDistinct(member).alias("_n"))
    return df.groupBy(group, item).agg(F.countDistinct(member).alias("_m")).join(members, group).where("_m = _n").select(group, item)


def union_ids(tables: list[DataFrame], id_: str) -> DataFrame:
    return reduce(DataFrame.union, [t.select(F.col(id_).cast("string").alias("id")) for t in tables]).where("id is not null").distinct()


def prefix_proof(whole: DataFrame, prefix: DataFrame, position: str, line: str) -> DataFrame:
    """Numbers of lines: in the prefix, equal to the whole's line of that position, different or missing there."""
    w = whole.select(F.col(position).alias("_p"), F.sha2(F.col(line).cast("binary"), 256).alias("_w"))
    j = prefix.select(F.col(position).alias("_p"), F.sha2(F.col(line).cast("binary"), 256).alias("_h")).join(w, "_p", "left")
    same = F.coalesce(F.col("_h") == F.col("_w"), F.lit(False))
    return j.agg(F.count("*").alias("n_prefix"), F.count_if(same).alias("n_equal"), F.count_if(~same).alias("n_different"))


# ---- aggregates ------------------------------------------------------------------------------------------------


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Number, mean, exact median, least and largest value."""
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.round(F.avg(value), 9).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def multiset(df: DataFrame, key: list[str], parts: list[str]) -> DataFrame:
    """(key, items): the combinations of parts and how often each occurs, as sorted JSON."""
    n = df.groupBy(*key, *parts).agg(F.count("*").alias("count"))
    return n.groupBy(*key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*parts, "count")))).alias("items"))


def code_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("n"))


def by_subset(df: DataFrame, subset: str, values: dict[str, Column]) -> DataFrame:
    """(subset, n, means) of each subset and of all rows together, in one pass."""
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(c), 9).alias(name) for name, c in values.items()]]
    name = F.when(F.grouping(subset) == 1, "all").otherwise(F.col(subset))
    return df.rollup(subset).agg(*aggs, name.alias("_name")).select(F.col("_name").alias("subset"), "n", *values)


def last_of(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The last k rows of each group, as ``back`` 1 to k."""
    return df.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("back") <= k)


def adequacy(df: DataFrame, by: str, status: str) -> DataFrame:
    """One status for a group of variants: adequate, else partially_adequate, else indeterminate, else inadequate."""
    any_ = lambda s: F.bool_or(F.col(status) == s)
    found = F.when(any_("adequate"), "adequate").when(any_("partially_adequate"), "partially_adequate").when(any_("indeterminate"), "indeterminate").otherwise("inadequate")
    return df.groupBy(by).agg(found.alias("status"), F.when(any_("adequate"), True).when(any_("partially_adequate"), False).when(any_("indeterminate"), F.lit(None).cast("boolean")).otherwise(False).alias("adequate"))


def sum_mismatches(parts: DataFrame, totals: DataFrame, by: str, part: str, total: str) -> DataFrame:
    """(by, total, parts): totals that are not the sum of their parts."""
    s = parts.groupBy(by).agg(F.sum(part).alias("parts"))
    return totals.join(s, by, "left").select(by, F.col(total).alias("total"), F.coalesce("parts", F.lit(0)).alias("parts")).where("not (total <=> parts)")
