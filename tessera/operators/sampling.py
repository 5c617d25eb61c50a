"""Deterministic samples: hash ranks, role ranges, quotas, balanced picks, disjointness, greedy coverage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_rank(seed: str, *ids: Column) -> Column:
    """sha256 of seed and ids with NUL between them."""
    parts = [x for c in (F.lit(seed), *ids) for x in (F.char(F.lit(0)), c.cast("string"))][1:]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def top_by_hash(df: DataFrame, id_: str, seed: str, k: int) -> DataFrame:
    """k rows by hash rank; only k rows of each task are shuffled."""
    return df.withColumn("rank_hash", hash_rank(seed, F.col(id_))).orderBy("rank_hash", id_).limit(k)


def role_split(df: DataFrame, id_: str, seed: str, roles: list[tuple[str, int]]) -> DataFrame:
    """Consecutive ranges of the hash order, a role each; rows beyond the last range are left out."""
    total = sum(n for _, n in roles)
    top = top_by_hash(df.select(id_), id_, seed, total).withColumn("rank", F.row_number().over(Window.orderBy("rank_hash", id_)))
    role, upto = None, 0
    for name, n in roles:
        upto += n
        role = F.when(F.col("rank") <= upto, name) if role is None else role.when(F.col("rank") <= upto, name)
    return top.select(id_, "rank", role.alias("role"))


def disjoint_proof(source: DataFrame, parts: dict[str, DataFrame], id_: str) -> DataFrame:
    """Number of ids: in the source, in no part, in several parts, in a part but not in the source."""
    all_ = source.select(id_).distinct().withColumn("in_source", F.lit(1)).withColumn("n_parts", F.lit(0))
    for p in parts.values():
        all_ = all_.unionByName(p.select(id_).distinct().withColumn("in_source", F.lit(0)).withColumn("n_parts", F.lit(1)))
    ids = all_.groupBy(id_).agg(F.max("in_source").alias("s"), F.sum("n_parts").alias("p"))
    return ids.agg(F.expr("count_if(s = 1)").alias("n_source"), F.expr("count_if(s = 1 and p = 0)").alias("n_uncovered"), F.expr("count_if(p > 1)").alias("n_shared"), F.expr("count_if(s = 0)").alias("n_foreign"))


def round_robin(position: Column, lanes: int, first: int = 0) -> Column:
    return F.pmod(position - 1, F.lit(lanes)) + first


#: No quota is larger, as counts have 63 bits: a limit that rows can meet before they are shuffled.
MOST = 64


def quota(n: Column) -> Column:
    """min(n, 1 + ceil(log2 n))"""
    return F.least(n, 1 + F.ceil(F.log2(n)))


def balanced_pick(df: DataFrame, lane: str, flag: str, id_: str, seed: str, k: int) -> DataFrame:
    """From each lane the flagged rows first, then others by hash rank, k in all."""
    order = Window.partitionBy(lane).orderBy(F.desc(flag), hash_rank(seed, F.col(id_)), id_)
    return df.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def quota_pick(df: DataFrame, family: str, id_: str, seed: str) -> DataFrame:
    """From each family its quota of rows by hash rank; tasks pass on at most ``MOST`` rows a family, however many it has."""
    order = Window.partitionBy(family).orderBy(_family_rank(seed, family, id_), id_)
    first = df.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= MOST)
    return _with_quota(first, df, family).where(F.col("pick") <= F.col("quota"))


def _family_rank(seed: str, family: str, id_: str) -> Column:
    """The hash rank of a row in its family; a null family ranks as the empty name."""
    return hash_rank(seed, F.coalesce(F.col(family).cast("string"), F.lit("")), F.col(id_))


def _with_quota(rows: DataFrame, df: DataFrame, family: str) -> DataFrame:
    """``rows`` with the quota of their family in ``df``; null is a family."""
    n = df.groupBy(F.col(family).alias("_f")).agg(quota(F.count("*")).cast("int").alias("quota"))
    return rows.join(n, F.col(family).eqNullSafe(F.col("_f"))).drop("_f")


def greedy_coverage(df: DataFrame, family: str, id_: str, features: list[str], seed: str) -> DataFrame:
    """(family, id, pick): from each family, up to its quota, the row that adds most unseen feature values; ties by hash rank.

    Rows of a family that have the same features are one candidate, the first by
    hash rank first, so a family comes as its distinct feature rows, ``quota`` of each at most.
    """
    same = Window.partitionBy(family, *features).orderBy("_h", id_)
    first = df.withColumn("_h", _family_rank(seed, family, id_)).withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= MOST)
    rows = _with_quota(first, df, family).where(F.col("_r") <= F.col("quota")).select(family, id_, "_h", "quota", *[F.col(f).cast("string").alias(f) for f in features])

    def pick(rows: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", id_])
        left = [(r[id_], {(f, r[f]) for f in features if r[f] is not None}) for r in rows.to_dict("records")]
        seen, out = set(), []
        while left and len(out) < int(rows["quota"].iloc[0]):
            best = max(range(len(left)), key=lambda i: len(left[i][1] - seen))
            got, values = left.pop(best)
            seen |= values
            out.append((rows[family].iloc[0], got, len(out) + 1))
        return pd.DataFrame(out, columns=[family, id_, "pick"])

    kind = rows.schema
    return rows.groupBy(family).applyInPandas(pick, f"{family} {kind[family].dataType.simpleString()}, {id_} {kind[id_].dataType.simpleString()}, pick int")


def exposed_anti_join(source: DataFrame, exposed: DataFrame, id_: str) -> DataFrame:
    """Rows whose id has not been exposed."""
    return source.join(exposed.select(id_).where(F.col(id_).isNotNull()).distinct(), id_, "left_anti")
