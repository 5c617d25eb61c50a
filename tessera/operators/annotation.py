"""Rules of layered annotations as violation rows (rule, key, message).

A layer is a table of long form: one row an identifier, a reference, a port or a
binding, told apart by the columns of its record (``by``).  Keys of violations are
the record's columns and the identifier, joined by ``:``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .rules import violation


def _at(*columns: str) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


# ---- identifiers and references --------------------------------------------------------------------------------


def repeated(df: DataFrame, by: list[str], id_: str, rule: str) -> DataFrame:
    """Identifiers that a record holds more than once, or as null."""
    n = df.groupBy(*by, id_).agg(F.count("*").alias("_n")).where(F.col(id_).isNull() | (F.col("_n") > 1))
    return violation(n, rule, _at(*by, id_), F.when(F.col(id_).isNull(), "missing").otherwise("repeated"))


def unresolved(refs: DataFrame, by: list[str], ref: str, known: DataFrame, id_: str, rule: str) -> DataFrame:
    """References to what the same record does not hold."""
    have = known.select(*by, F.col(id_).alias(ref)).distinct()
    return violation(refs.where(F.col(ref).isNotNull()).select(*by, ref).distinct().join(have, [*by, ref], "left_anti"), rule, _at(*by, ref), F.lit("unknown"))


def uncovered(required: DataFrame, by: list[str], id_: str, observed: DataFrame, ref: str, rule: str) -> DataFrame:
    """What one layer requires and the next never refers to."""
    seen = observed.select(*by, F.col(ref).alias(id_)).distinct()
    return violation(required.where(F.col(id_).isNotNull()).select(*by, id_).distinct().join(seen, [*by, id_], "left_anti"), rule, _at(*by, id_), F.lit("not covered"))


def outside(df: DataFrame, by: list[str], value: str, allowed: list[str], rule: str) -> DataFrame:
    """Values that are none of a closed set; null is none."""
    return violation(df.where(~F.coalesce(F.col(value).isin(*allowed), F.lit(False))), rule, _at(*by), F.coalesce(F.col(value).cast("string"), F.lit("missing")))


def role_overlap(df: DataFrame, id_: str, role: str, rule: str = "role_overlap") -> DataFrame:
    """Identifiers with more than one role."""
    n = df.groupBy(id_).agg(F.min(role).alias("_lo"), F.max(role).alias("_hi")).where("_lo <> _hi")
    return violation(n, rule, _at(id_), F.concat_ws(", ", "_lo", "_hi"))


def differing(have: DataFrame, pinned: DataFrame, by: list[str], compared: list[str], rule: str = "pinned") -> DataFrame:
    """Rows of a pinned table that are missing or extra, and each column that is not as pinned; ``by`` is a key of both."""
    old = pinned.select(*by, F.struct(*compared).alias("_p"))
    both = have.select(*by, F.struct(*compared).alias("_h")).join(old, by, "full")
    at = [F.when(~F.col(f"_h.{c}").eqNullSafe(F.col(f"_p.{c}")), F.lit(c)) for c in compared]
    what = F.when(F.col("_h").isNull(), F.array(F.lit("missing"))).when(F.col("_p").isNull(), F.array(F.lit("extra"))).otherwise(F.array_compact(F.array(*at)))
    return violation(both.select(*by, F.explode(what).alias("_w")), rule, _at(*by), F.col("_w"))


# ---- nodes against the vocabulary ------------------------------------------------------------------------------


def contract(nodes: DataFrame, slots: DataFrame, vocabulary: DataFrame, by: list[str], slot: str, compared: list[str], rule: str) -> DataFrame:
    """Slots or ports of nodes (by, operator) against those that the vocabulary (operator, slot) gives their operator.

    missing, unknown and repeated ones, and for those found once the compared columns that differ.
    """
    wanted = nodes.select(*by, "operator").join(vocabulary.select("operator", slot, F.struct(*compared).alias("_v")), "operator").drop("operator")
    have = slots.groupBy(*by, slot).agg(F.count("*").alias("_n"), F.min(F.struct(*compared)).alias("_h"))
    both = have.join(wanted, [*by, slot], "full")
    differ = [F.when(~F.col(f"_h.{c}").eqNullSafe(F.col(f"_v.{c}")), F.lit(f"other {c}")) for c in compared]
    what = (
        F.when(F.col("_n").isNull(), F.array(F.lit("missing")))
        .when(F.col("_v").isNull(), F.array(F.lit("unknown")))
        .when(F.col("_n") > 1, F.array(F.lit("repeated")))
        .otherwise(F.array_compact(F.array(*differ)))
    )
    return violation(both.select(*by, slot, F.explode(what).alias("_w")), rule, _at(*by, slot), F.col("_w"))


def wiring(inputs: DataFrame, outputs: DataFrame, depends: DataFrame, by: list[str], rule: str = "wiring") -> DataFrame:
    """The first fault of each input that takes another node's output.

    inputs: by, node, port, source_node, source_port, type, cardinality; outputs: by, node,
    port, type, cardinality; depends: by, node, depends_on.  Faults in this order: the source is no
    node, is not a declared dependency, has no such port, or its type or cardinality does not fit.
    """
    known = outputs.select(*by, F.col("node").alias("source_node"), F.lit(1).alias("_node")).distinct()
    declared = depends.select(*by, "node", F.col("depends_on").alias("source_node"), F.lit(1).alias("_edge")).distinct()
    ports = outputs.groupBy(*by, F.col("node").alias("source_node"), F.col("port").alias("source_port")).agg(F.min(F.struct("type", "cardinality")).alias("_o"))
    x = inputs.join(ports, [*by, "source_node", "source_port"], "left").join(known, [*by, "source_node"], "left").join(declared, [*by, "node", "source_node"], "left")
    fault = (
        F.when(F.col("_node").isNull(), "unknown source")
        .when(F.col("_edge").isNull(), "source is no declared dependency")
        .when(F.col("_o").isNull(), "source has no such port")
        .when(~X.compatible_types(F.col("_o.type"), F.col("type")), "type does not fit")
        .when(~X.compatible_cardinalities(F.col("_o.cardinality"), F.col("cardinality"), F.col("type")), "cardinality does not fit")
    )
    return violation(x.withColumn("_w", fault).where("_w is not null"), rule, _at(*by, "node", "port"), F.col("_w"))


# ---- groundings ------------------------------------------------------------------------------------------------

# The kinds of binding that a source of each modality takes; unknown takes none.
BINDINGS = {
    "question_literal": ["question_literal"],
    "table_metadata": ["table_scope"],
    "table_header": ["table_column", "table_scope"],
    "table_row_or_cell": ["table_column", "table_scope", "dynamic"],
    "cell_link": ["cell_link", "dynamic"],
    "linked_document_text": ["linked_document", "dynamic"],
    "unknown": [],
}


def binding_kinds(bindings: DataFrame, by: list[str], modality: str, kind: str, rule: str = "binding_kind") -> DataFrame:
    """Bindings of a kind that the modality of their source does not take."""
    fits = F.lit(False)
    for m, kinds in BINDINGS.items():
        fits = fits | ((F.col(modality) == m) & F.col(kind).isin(*kinds)) if kinds else fits
    return violation(bindings.where(~F.coalesce(fits, F.lit(False))), rule, _at(*by), F.concat_ws(" as ", modality, kind))


def groundings(bindings: DataFrame, nodes: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """Bindings (by, node, coverage) of unknown nodes, several of one node, and nodes that a full claim (by, status) leaves open."""
    n = bindings.groupBy(*by, "node").agg(F.count("*").alias("_n"), F.bool_and(F.coalesce(F.col("coverage") == "all_required_slots_grounded", F.lit(False))).alias("_all"))
    both = nodes.select(*by, "node", F.lit(1).alias("_node")).distinct().join(n, [*by, "node"], "full")
    both = both.join(claims.where("status = 'fully_grounded'").select(*by, F.lit(1).alias("_full")).distinct(), by, "left")
    what = F.array_compact(
        F.array(
            F.when(F.col("_node").isNull(), "unknown node"),
            F.when(F.col("_n") > 1, "several bindings"),
            F.when(F.col("_full").isNotNull() & F.col("_node").isNotNull() & F.col("_n").isNull(), "no binding"),
            F.when(F.col("_full").isNotNull() & F.col("_node").isNotNull() & ~F.col("_all"), "slots left open"),
        )
    )
    return violation(both.select(*by, "node", F.explode(what).alias("_w")), "grounding", _at(*by, "node"), F.col("_w"))


# ---- review ----------------------------------------------------------------------------------------------------

# The least and most reviews that a state of review stands for.
REVIEWS = {
    "llm_proposed": (0, 0),
    "deterministic_validation_only": (0, 0),
    "llm_assisted_pending_human": (0, 0),
    "human_single_review": (1, 1),
    "human_double_review_unadjudicated": (2, None),
    "adjudicated": (2, None),
}


def review_states(records: DataFrame, reviewers: DataFrame, id_: str) -> DataFrame:
    """Reviews that contradict themselves.

    records: id, state, gold_claimed, human_review_count, has_adjudication, bundle_status;
    reviewers: id, reviewer_id, a row a review.
    """
    n = reviewers.groupBy(id_).agg(F.count("*").alias("_rows"), F.count("reviewer_id").alias("_named"), F.countDistinct("reviewer_id").alias("_people"))
    x = records.join(n, id_, "left").fillna(0, ["_rows", "_named", "_people"])
    count, state, bundle = F.col("human_review_count"), F.col("state"), F.col("bundle_status")
    range_broken = F.lit(False)
    for name, (least, most) in REVIEWS.items():
        wrong = (count < least) | (count > most) if most is not None else count < least
        range_broken = range_broken | ((state == name) & wrong)
    by_people = bundle.isin("human_reviewed", "adjudicated")
    tests = {
        "gold_claimed": F.col("gold_claimed"),
        "reviewer_without_id": F.col("_named") < F.col("_rows"),
        "reviewer_repeated": F.col("_people") < F.col("_named"),
        "count_disagrees": ~count.eqNullSafe(F.col("_people")),
        "state_disagrees": range_broken,
        "adjudication_missing": (state == "adjudicated") & ~F.coalesce("has_adjudication", F.lit(False)),
        "bundle_without_review": (count == 0) & by_people,
        "bundle_of_unreviewed": state.isin(*[s for s, (_, most) in REVIEWS.items() if most == 0]) & by_people,
        "bundle_of_adjudicated": (state == "adjudicated") & ~F.coalesce(bundle.isin("adjudicated", "ambiguous_preserved", "rejected"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return violation(x.select(id_, F.explode(broken).alias("_w")), "review_status", _at(id_), F.col("_w"))
