"""Candidates against a target graph: mapped edges, dependencies kept, missing and added, placement of access, eligibility.

Tables: edges (graph_id, src, dst) of targets and of candidates' operators, mappings (graph_id, node, operator) from
target nodes to operators; ``reach`` tables are closures of the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .agreement import set_hash


def mapped_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(graph_id, src, dst, inside): edges whose ends both have a group (graph_id, node, group), as edges of groups; inside: within one."""
    a = groups.select("graph_id", F.col("node").alias("src"), F.col("group").alias("g_src"))
    b = groups.select("graph_id", F.col("node").alias("dst"), F.col("group").alias("g_dst"))
    found = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    return found.select("graph_id", F.col("g_src").alias("src"), F.col("g_dst").alias("dst"), (F.col("g_src") == F.col("g_dst")).alias("inside"))


def mapped_profile(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(graph_id, edges, alignable, collapsed, projected): edges, those with grouped ends, of these those within a group, distinct others."""
    m = mapped_edges(edges, groups).groupBy("graph_id").agg(F.count("*").alias("alignable"), F.count_if("inside").alias("collapsed"), F.countDistinct(F.when(~F.col("inside"), F.struct("src", "dst"))).alias("projected"))
    n = edges.groupBy("graph_id").agg(F.count("*").alias("edges"))
    zero = F.lit(0)
    return n.join(m, "graph_id", "left").select("graph_id", "edges", *[F.coalesce(c, zero).alias(c) for c in ("alignable", "collapsed", "projected")])


def precedes(pairs: DataFrame, mappings: DataFrame, reach: DataFrame, fusion: bool = True) -> DataFrame:
    """(graph_id, src, dst) of those pairs of target nodes for which an operator of src comes before one of dst, or (fusion) is one of dst.

    Pairs meet reach by equal operators, so work is in proportion to what is mapped and reachable.
    """
    a = mappings.select("graph_id", F.col("node").alias("src"), F.col("operator").alias("o_src"))
    b = mappings.select("graph_id", F.col("node").alias("dst"), F.col("operator").alias("o_dst"))
    before = reach.select("graph_id", F.col("src").alias("o_src"), F.col("dst").alias("o_dst"))
    if fusion:
        same = mappings.select("graph_id", F.col("operator").alias("o_src"), F.col("operator").alias("o_dst"))
        before = before.union(same).distinct()
    held = before.join(a, ["graph_id", "o_src"]).join(b, ["graph_id", "o_dst"]).select("graph_id", "src", "dst").distinct()
    return pairs.select("graph_id", "src", "dst").distinct().join(held, ["graph_id", "src", "dst"], "left_semi")


def dependency_profile(target_reach: DataFrame, mappings: DataFrame, operator_reach: DataFrame) -> DataFrame:
    """(graph_id, src, dst, kind): dependencies of the target that operators keep (preserved) or don't (missing), and ones that they add (extra)."""
    wanted = target_reach.where("src <> dst").select("graph_id", "src", "dst").distinct()
    kept = precedes(wanted, mappings, operator_reach)
    a = mappings.select("graph_id", F.col("node").alias("src"), F.col("operator").alias("o_src"))
    b = mappings.select("graph_id", F.col("node").alias("dst"), F.col("operator").alias("o_dst"))
    before = operator_reach.select("graph_id", F.col("src").alias("o_src"), F.col("dst").alias("o_dst"))
    before = before.union(mappings.select("graph_id", F.col("operator").alias("o_src"), F.col("operator").alias("o_dst"))).distinct()
    held = before.join(a, ["graph_id", "o_src"]).join(b, ["graph_id", "o_dst"]).where("src <> dst").select("graph_id", "src", "dst").distinct()
    keys = ["graph_id", "src", "dst"]
    rows = kept.withColumn("kind", F.lit("preserved")).unionByName(wanted.join(kept, keys, "left_anti").withColumn("kind", F.lit("missing")))
    return rows.unionByName(held.join(wanted, keys, "left_anti").withColumn("kind", F.lit("extra")))


def assessment(nodes: DataFrame, mappings: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(graph_id, uncovered, missing, extra, status): not_equivalent for nodes without operator or missing dependencies, provisionally_equivalent for added ones."""
    lost = nodes.select("graph_id", "node").distinct().join(mappings, ["graph_id", "node"], "left_anti").groupBy("graph_id").agg(F.count("*").alias("uncovered"))
    d = dependencies.groupBy("graph_id").agg(F.count_if(F.col("kind") == "missing").alias("missing"), F.count_if(F.col("kind") == "extra").alias("extra"))
    out = nodes.select("graph_id").distinct().join(lost, "graph_id", "left").join(d, "graph_id", "left").na.fill(0, ["uncovered", "missing", "extra"])
    return out.withColumn("status", F.when(F.expr("uncovered > 0 or missing > 0"), "not_equivalent").when(F.col("extra") > 0, "provisionally_equivalent").otherwise("equivalent"))


def placement(operators: DataFrame, semantic: DataFrame, reach: DataFrame) -> DataFrame:
    """(graph_id, node, placement): where an access operator stands among the semantic ones (graph_id, node)."""
    up = reach.join(semantic.withColumnRenamed("node", "dst"), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node"), F.lit(1).alias("before"), F.lit(0).alias("after"))
    down = reach.join(semantic.withColumnRenamed("node", "src"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node"), F.lit(0).alias("before"), F.lit(1).alias("after"))
    near = up.union(down).groupBy("graph_id", "node").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    what = F.when(F.expr("before = 1 and after = 1"), "explicit_between_semantics").when(F.col("before") == 1, "explicit_before_semantic").when(F.col("after") == 1, "explicit_after_semantic").otherwise("explicit_disconnected")
    return operators.select("graph_id", "node").distinct().join(near, ["graph_id", "node"], "left").select("graph_id", "node", what.alias("placement"))


def eligibility(ineligible: Column, provisional: Column) -> Column:
    """Status of a candidate from its lists of reasons."""
    return F.when(F.size(ineligible) > 0, "ineligible").when(F.size(provisional) > 0, "provisional_only").otherwise("full_eligible")


def record_sets(candidates: DataFrame, by: list[str], status: str, sig: str) -> DataFrame:
    """For each group its candidates by eligibility, and the distinct signatures of the full and of the provisional ones with the hash of the former."""
    of = lambda s: F.when(F.col(status) == s, F.col(sig))
    return candidates.groupBy(*by).agg(
        F.count("*").alias("candidates"), *[F.count_if(F.col(status) == s).alias(s) for s in ("full_eligible", "provisional_only", "ineligible")],
        F.countDistinct(of("full_eligible")).alias("full_signatures"), F.countDistinct(of("provisional_only")).alias("provisional_signatures"), set_hash(of("full_eligible")).alias("full_set_hash"),
    )


def family_sets(sets: DataFrame, family: str, hashes: list[str]) -> DataFrame:
    """(family, component, questions, profiles, stable): how many different sets the members of a family have, for each kind of set."""
    rows = sets.select(family, F.explode(F.array(*[F.struct(F.lit(h).alias("component"), F.col(h).alias("h")) for h in hashes])).alias("x")).select(family, "x.*")
    return rows.groupBy(family, "component").agg(F.count("*").alias("questions"), F.countDistinct("h").alias("profiles")).withColumn("stable", F.col("profiles") == 1)


def layer_coverage(groups: DataFrame, unmatched: DataFrame, by: str) -> DataFrame:
    """For each alignment: strict and compatible coverage of both sides and their harmonic means.

    groups: (by, status, n_left, n_right); unmatched: (by, side).  Nothing to cover counts as covered.
    """
    strict, compatible = F.col("status") == "equivalent", F.col("status").isin("equivalent", "compatible_split_merge")
    part = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0))
    g = groups.groupBy(by).agg(*[f.alias(f"{s}_{k}") for s in ("left", "right") for k, f in (("all", F.sum(f"n_{s}")), ("strict", part(strict, f"n_{s}")), ("compatible", part(compatible, f"n_{s}")))])
    u = unmatched.groupBy(by).agg(*[F.count_if(F.col("side") == s).alias(f"{s}_un") for s in ("left", "right")])
    both = g.join(u, by, "full").na.fill(0)
    share = lambda s, k: F.coalesce(F.try_divide(F.col(f"{s}_{k}"), F.col(f"{s}_all") + F.col(f"{s}_un")), F.lit(1.0))
    out = [F.round(share(s, k), 9).alias(f"{s}_{k}_coverage") for s in ("left", "right") for k in ("strict", "compatible")]
    mean = [F.round(F.coalesce(F.try_divide(2 * share("left", k) * share("right", k), share("left", k) + share("right", k)), F.lit(0.0)), 9).alias(f"symmetric_{k}_coverage") for k in ("strict", "compatible")]
    return both.select(by, *out, *mean)


def question_disposition(unresolved: Column, material: Column, all_equivalent: Column, unmatched: Column, one_to_one: Column, graph_equal: Column) -> Column:
    """INDETERMINATE before SUBSTANTIVE_DISAGREEMENT before FULL_EQUIVALENCE before COMPATIBLE_VARIATION."""
    full = all_equivalent & (unmatched == 0) & one_to_one & graph_equal
    return F.when(unresolved, "INDETERMINATE").when(material, "SUBSTANTIVE_DISAGREEMENT").when(full, "FULL_EQUIVALENCE").otherwise("COMPATIBLE_VARIATION")


def structural_comparison(a: DataFrame, b: DataFrame, id_: str, numbers: list[str], flags: list[str]) -> DataFrame:
    """Share of ids whose invariants are all equal, mean absolute difference of each number, share of equal flags."""
    j = a.join(b.select(id_, *[F.col(c).alias(f"_b_{c}") for c in numbers + flags]), id_)
    same = F.lit(True)
    for c in numbers + flags:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    rate = lambda t: F.round(F.avg(t.cast("double")), 9)
    return j.agg(F.count("*").alias("n"), rate(same).alias("exact"), *[F.round(F.avg(F.abs(F.col(c) - F.col(f"_b_{c}"))), 9).alias(f"diff_{c}") for c in numbers], *[rate(F.col(c).eqNullSafe(F.col(f"_b_{c}"))).alias(f"same_{c}") for c in flags])


def graph_profile(degrees: DataFrame, depths: DataFrame) -> DataFrame:
    """(graph_id, nodes, profile_hash): the multiset of (depth, indegree, outdegree) of a graph, hashed."""
    n = degrees.join(depths, ["graph_id", "node"]).groupBy("graph_id", "depth", "indegree", "outdegree").agg(F.count("*").alias("n"))
    line = F.concat_ws(":", "depth", "indegree", "outdegree", "n")
    return n.groupBy("graph_id").agg(F.sum("n").alias("nodes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";").cast("binary"), 256).alias("profile_hash"))
