"""Rules as violation rows (rule, key, message): data pass if their union is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(df: DataFrame, rule: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), message.alias("message"))


def duplicate_ids(df: DataFrame, id_: str, rule: str = "duplicate_id") -> DataFrame:
    found = df.groupBy(id_).agg(F.count("*").alias("_n")).where("_n > 1")
    return violation(found, rule, F.col(id_), F.concat(F.col("_n").cast("string"), F.lit(" rows")))


def dangling_refs(df: DataFrame, ref: str, target: DataFrame, id_: str, rule: str = "dangling_ref") -> DataFrame:
    known = target.select(F.col(id_).alias("_id"))
    found = df.where(F.col(ref).isNotNull()).groupBy(ref).agg(F.count("*").alias("_n")).join(known, F.col(ref) == F.col("_id"), "left_anti")
    return violation(found, rule, F.col(ref), F.concat(F.col("_n").cast("string"), F.lit(" references")))


def exact_ids(df: DataFrame, expected: DataFrame, id_: str, rule: str = "exact_ids") -> DataFrame:
    """Ids that are missing, extra or repeated."""
    have = df.groupBy(id_).agg(F.count("*").alias("_n"))
    both = have.join(expected.select(id_).distinct().withColumn("_e", F.lit(1)), id_, "full")
    what = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") > 1, "repeated")
    return violation(both.withColumn("_w", what).where("_w is not null"), rule, F.col(id_), F.col("_w"))


def multiset_cover(have: DataFrame, want: DataFrame, item: str, rule: str = "multiset") -> DataFrame:
    """Items whose numbers differ."""
    n = have.select(item, F.lit(1).alias("h"), F.lit(0).alias("w")).union(want.select(item, F.lit(0), F.lit(1))).groupBy(item).agg(F.sum("h").alias("h"), F.sum("w").alias("w"))
    return violation(n.where("h <> w"), rule, F.col(item), F.concat_ws(" of ", F.col("h").cast("string"), F.col("w").cast("string")))


def span_match(df: DataFrame, key: str, text: str, start: str, end: str, span: str, rule: str = "span") -> DataFrame:
    """Spans [start, end) in code points that are not the text they claim."""
    there = F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start))
    return violation(df.where(~there.eqNullSafe(F.col(span))), rule, F.col(key), there)


def forbidden_keys(df: DataFrame, key: str, json: str, forbidden: list[str], rule: str = "forbidden_key") -> DataFrame:
    """Keys of a JSON object that, without case and marks, are forbidden."""
    names = F.explode(F.json_object_keys(json)).alias("name")
    found = df.select(F.col(key).alias("_k"), names)
    return violation(found.where(F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").isin(*forbidden)), rule, F.col("_k"), F.col("name"))


def check_all(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


# ---- rules for graphs ------------------------------------------------------------------------------------------


def graph_rules(nodes: DataFrame, edges: DataFrame, reach: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Repeated nodes, unknown ends, loops, cycles and, with ``labels``, unknown labels; keys are graph:node."""
    at = lambda c: F.concat_ws(":", F.col("graph_id").cast("string"), F.col(c).cast("string"))
    n = nodes.select("graph_id", "node").distinct()
    ends = edges.select("graph_id", F.col("src").alias("node")).union(edges.select("graph_id", "dst")).distinct()
    out = [
        violation(nodes.groupBy("graph_id", "node").count().where("count > 1"), "duplicate_node", at("node"), F.lit("repeated")),
        violation(ends.join(n, ["graph_id", "node"], "left_anti"), "unknown_node", at("node"), F.lit("not a node")),
        violation(edges.where("src = dst"), "self_loop", at("src"), F.lit("depends on itself")),
        violation(reach.where("src = dst").join(edges.where("src = dst"), ["graph_id", "src", "dst"], "left_anti"), "cycle", at("src"), F.lit("on a cycle")),
    ]
    if labels is not None:
        out.append(violation(nodes.where(~F.col("label").isin(*labels)), "unknown_label", at("node"), F.col("label")))
    return check_all(*out)
