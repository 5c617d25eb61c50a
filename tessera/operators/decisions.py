"""Decisions over one row of metrics: the triggers or the branch that holds first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import families as A

# Thresholds and names of the branches.
EXPAND, FREEZE = "EXPAND_UNCHANGED_TO_N300", "FREEZE_CANDIDATE_LIBRARY_AND_BEGIN_REPRESENTATIVE_ENVIRONMENT_REALIZATION"
SINGLETON_100, SINGLETON_1000, OTHER_RATE, NOVELTY, RECURRING = 0.10, 0.05, 0.05, 0.10, 2


def _one(*rows: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(F.broadcast(r))
    return out


def other_rate(records: DataFrame, other: str) -> DataFrame:
    return records.agg(F.try_divide(F.count_if(F.col(other)), F.count("*")).alias("other_rate"))


def first_expansion(records: DataFrame, prefix: int, other: str = "other", size: int = 10) -> DataFrame:
    """Four triggers, any of which asks for more records: singleton mass, rate of OTHER, novelty of both last blocks, recurring new families."""
    last = A.tail_blocks(A.block_novelty(records, size), 2).agg(F.count("*").alias("k"), F.min(F.try_divide("novel_records", "records")).alias("least"))
    again = A.partition_support(records, prefix, size).agg(F.count("*").alias("recurring"))
    mass = A.counts(records).agg(F.try_divide(F.count_if(F.col("n") == 1), F.sum("n")).alias("mass"))
    t = _one(mass, other_rate(records, other), last, again)
    t = t.select(
        F.coalesce(F.col("mass") > SINGLETON_100, F.lit(False)).alias("singleton_mass"), F.coalesce(F.col("other_rate") > OTHER_RATE, F.lit(False)).alias("other_rate"),
        F.coalesce((F.col("k") == 2) & (F.col("least") > NOVELTY), F.lit(False)).alias("last_blocks"), (F.col("recurring") >= RECURRING).alias("recurring"),
    )
    return t.withColumn("decision", F.when(F.col("singleton_mass") | F.col("other_rate") | F.col("last_blocks") | F.col("recurring"), EXPAND).otherwise(FREEZE))


def second_expansion(records: DataFrame, prefix: int, yes: str, no: str, other: str = "other", size: int = 10, tail: int = 5) -> DataFrame:
    """Four triggers, all strict: singleton mass, rate of OTHER, novelty of the last blocks with two new families at least, material new families."""
    later = records.where(F.col("position") > prefix).withColumn("block", A.block_of(F.col("position"), size)).groupBy("sig", "block").agg(F.count("*").alias("n"))
    known = records.where(F.col("position") <= prefix).select("sig").distinct().withColumn("known", F.lit(True))
    first = later.groupBy("sig").agg(F.min("block").alias("first"))
    new = later.join(first, "sig").join(known, "sig", "left").withColumn("new", F.col("known").isNull() & (F.col("first") == F.col("block")))
    last = F.broadcast(A.tail_blocks(later.select("block").distinct(), tail))
    tail_ = new.join(last, "block").agg(F.sum("n").alias("t_n"), F.coalesce(F.sum(F.when(F.col("new"), F.col("n"))), F.lit(0)).alias("t_new"), F.countDistinct(F.when(F.col("new"), F.col("sig"))).alias("t_families"), F.countDistinct("block").alias("t_blocks"))
    material = A.partition_support(records, prefix, size).agg(F.count_if("material").alias("material"))
    mass = A.counts(records).agg(F.try_divide(F.count_if(F.col("n") == 1), F.sum("n")).alias("mass"))
    t = _one(mass, other_rate(records, other), tail_, material)
    enough = F.when(F.col("t_blocks") == tail, F.try_divide("t_new", "t_n")).otherwise(F.raise_error(F.lit("TOO_FEW_BLOCKS")).cast("double"))
    t = t.select(
        (F.col("mass") > SINGLETON_1000).alias("singleton_mass"), (F.col("other_rate") > OTHER_RATE).alias("other_rate"), ((enough > NOVELTY) & (F.col("t_families") >= 2)).alias("tail_novelty"),
        (F.col("material") >= 2).alias("material"), F.round(enough, 9).alias("tail_rate"),
    )
    return t.withColumn("decision", F.when(F.col("singleton_mass") | F.col("other_rate") | F.col("tail_novelty") | F.col("material"), yes).otherwise(no))


def branch(gates: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first gate that fails, else ``otherwise``; a gate that is null fails."""
    out = None
    for passes, name in gates:
        fails = ~F.coalesce(passes, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out.otherwise(otherwise)


def normalization_branch(technical_loss: Column, not_equivalent: Column, provisional: Column, unstable: Column, separable: Column, limits: dict[str, float]) -> Column:
    """Loss first, then whether effects can be told apart, then the fractions."""
    return branch([
        ((technical_loss <= limits["technical_loss"]) & (not_equivalent <= limits["not_equivalent"]), "REVISE_NORMALIZATION_CONTRACT_TECHNICAL_OR_SEMANTIC_LOSS"),
        (separable, "RUN_PRECOMMITTED_CROSSED_AUTHOR_SENSITIVITY"),
        ((provisional <= limits["provisional"]) & (unstable <= limits["unstable"]), "REVISE_NORMALIZATION_CONTRACT_THRESHOLD_FAILURE"),
    ], "ALLOW_PROVISIONAL_NON_FINAL_GROUNDING_ADAPTER")


def within(most: dict[str, float] | None = None, least: dict[str, float] | None = None, equal: dict[str, float] | None = None) -> Column:
    """Whether all columns keep their limits; null keeps none."""
    tests = [F.col(c) <= v for c, v in (most or {}).items()] + [F.col(c) >= v for c, v in (least or {}).items()] + [F.col(c) == v for c, v in (equal or {}).items()]
    out = F.lit(True)
    for x in tests:
        out = out & F.coalesce(x, F.lit(False))
    return out


def crossed_branch(most: dict[str, float], least: dict[str, float], yes: str, no: str) -> Column:
    """All criteria or none."""
    return F.when(within(most, least), yes).otherwise(no)


def staged_branch(technical: Column, coverage: Column, semantic: Column, names: tuple[str, str, str, str]) -> Column:
    """Technical contract, then coverage, then semantic stability; the fourth name if all hold."""
    return branch([(technical, names[0]), (coverage, names[1]), (semantic, names[2])], names[3])


def grounding_branch(technical_errors: Column, unavailable: Column, delivered: Column, resolved: Column, unresolved: Column, expected: int = 14) -> Column:
    """Failures and incomplete delivery cannot become passes; counts that cannot be raise."""
    counts = [technical_errors, unavailable, delivered, resolved, unresolved]
    sound = (delivered <= expected) & (resolved <= delivered)
    for c in counts:
        sound = sound & (c >= 0)
    found = branch([
        (technical_errors == 0, "STOP_TECHNICAL_OR_LEAKAGE_FAILURE"), (unavailable == 0, "BLOCKED_PINNED_ENVIRONMENT_UNAVAILABLE"), (delivered == expected, "INCOMPLETE_GROUNDING_COLLECTION"),
        ((resolved == expected) & (unresolved == 0), "REVIEW_AMBIGUITY_OR_COVERAGE_BEFORE_EXECUTION_PLAN"),
    ], "FREEZE_GROUNDING_EVIDENCE_FOR_SEPARATE_EXECUTION_PLAN")
    return F.when(F.coalesce(sound, F.lit(False)), found).otherwise(F.raise_error(F.lit("INVALID_DECISION_COUNTS")).cast("string"))
