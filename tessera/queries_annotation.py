"""The catalogue's third part: rules of layered annotations, and plans that join, retrieve strictly and select by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import annotation as V
from .operators import relational as R
from .plans.compile import compile_plan
from .queries import LABELS, column, documents, is_, node, plan, query

# ---- identifiers and references --------------------------------------------------------------------------------

ORDER = ["l_orderkey"]
query(
    "ann_repeated",
    "SELECT 'requirement' AS rule, l_orderkey || ':' || coalesce(s::VARCHAR, 'null') AS key, CASE WHEN s IS NULL THEN 'missing' ELSE 'repeated' END AS message FROM (SELECT l_orderkey, nullif(l_suppkey, 7) AS s FROM lineitem) GROUP BY l_orderkey, s HAVING s IS NULL OR count(*) > 1",
    lambda t: V.repeated(t.lineitem.selectExpr("l_orderkey", "nullif(l_suppkey, 7) AS s"), ORDER, "s", "requirement"),
)
query(
    "ann_unresolved",
    "SELECT DISTINCT 'reference' AS rule, l_orderkey || ':' || l_suppkey AS key, 'unknown' AS message FROM lineitem WHERE (l_orderkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_suppkey) FROM lineitem WHERE l_quantity > 10)",
    lambda t: V.unresolved(t.lineitem, ORDER, "l_suppkey", t.lineitem.where("l_quantity > 10").withColumnRenamed("l_suppkey", "id"), "id", "reference"),
)
query(
    "ann_uncovered",
    "SELECT DISTINCT 'obligations' AS rule, l_orderkey || ':' || l_linenumber AS key, 'not covered' AS message FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber - 1 = a.l_linenumber)",
    lambda t: V.uncovered(t.lineitem.where("l_returnflag = 'R'"), ORDER, "l_linenumber", t.lineitem.withColumn("of", F.col("l_linenumber") - 1), "of", "obligations"),
)
query(
    "ann_outside",
    "SELECT 'semantic_function' AS rule, event_id::VARCHAR AS key, event_type AS message FROM events WHERE event_type NOT IN ('click', 'view')",
    lambda t: V.outside(t.events, ["event_id"], "event_type", ["click", "view"], "semantic_function"),
)
query(
    "ann_role_overlap",
    "SELECT 'role_overlap' AS rule, l_orderkey::VARCHAR AS key, min(l_returnflag) || ', ' || max(l_returnflag) AS message FROM lineitem GROUP BY l_orderkey HAVING min(l_returnflag) <> max(l_returnflag)",
    lambda t: V.role_overlap(t.lineitem, "l_orderkey", "l_returnflag"),
)
query(
    "ann_pinned",
    """WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0), p AS (SELECT * FROM customer WHERE c_custkey % 11 <> 0),
b AS (SELECT coalesce(h.c_custkey, p.c_custkey) AS k, h.c_custkey AS hk, p.c_custkey AS pk, h.c_nationkey IS DISTINCT FROM p.c_nationkey AS n, h.c_mktsegment IS DISTINCT FROM p.c_mktsegment AS m FROM h FULL JOIN p USING (c_custkey)),
w AS (SELECT k, CASE WHEN hk IS NULL THEN 'missing' WHEN pk IS NULL THEN 'extra' END AS message FROM b UNION ALL SELECT k, 'c_nationkey' FROM b WHERE hk = pk AND n UNION ALL SELECT k, 'c_mktsegment' FROM b WHERE hk = pk AND m)
SELECT 'pinned' AS rule, k::VARCHAR AS key, message FROM w WHERE message IS NOT NULL""",
    lambda t: V.differing(
        t.customer.where("c_custkey % 7 <> 0").selectExpr("c_custkey", "if(c_custkey % 5 = 0, c_nationkey + 1, c_nationkey) AS c_nationkey", "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment"),
        t.customer.where("c_custkey % 11 <> 0"),
        ["c_custkey"],
        ["c_nationkey", "c_mktsegment"],
    ),
)

# ---- nodes against the vocabulary ------------------------------------------------------------------------------

_KIND = "CASE WHEN (slot + length(operator)) % 3 = 0 THEN 'R' ELSE 'N' END"
query(
    "ann_contract",
    f"""WITH n AS (SELECT DISTINCT o_orderkey AS node, o_orderpriority AS operator FROM orders), v AS (SELECT operator, slot, {_KIND} AS kind FROM (SELECT DISTINCT operator FROM n), (SELECT unnest(range(1, 4)) AS slot)),
w AS (SELECT node, slot, kind FROM n JOIN v USING (operator)), h AS (SELECT l_orderkey AS node, l_linenumber AS slot, count(*) AS c, min(l_returnflag) AS kind FROM lineitem GROUP BY 1, 2),
b AS (SELECT node, slot, CASE WHEN c IS NULL THEN 'missing' WHEN w.kind IS NULL THEN 'unknown' WHEN c > 1 THEN 'repeated' WHEN h.kind IS DISTINCT FROM w.kind THEN 'other kind' END AS message FROM h FULL JOIN w USING (node, slot))
SELECT 'argument_slots' AS rule, node || ':' || slot AS key, message FROM b WHERE message IS NOT NULL""",
    lambda t: V.contract(
        t.orders.selectExpr("o_orderkey AS node", "o_orderpriority AS operator").distinct(),
        t.lineitem.selectExpr("l_orderkey AS node", "l_linenumber AS slot", "l_returnflag AS kind"),
        t.orders.selectExpr("o_orderpriority AS operator").distinct().selectExpr("operator", "explode(sequence(1, 3)) AS slot").selectExpr("operator", "slot", f"{_KIND} AS kind"),
        ["node"],
        "slot",
        ["kind"],
        "argument_slots",
    ),
)

_OUT = "CASE l_suppkey % 3 WHEN 0 THEN 'Row' WHEN 1 THEN 'Number' ELSE 'ValueSet' END"
_TYPE = "CASE l_partkey % 3 WHEN 0 THEN 'Row' WHEN 1 THEN 'Number' ELSE 'ValueSet' END"
_CARD = "CASE WHEN l_partkey % 2 = 0 THEN 'one' ELSE 'zero_or_more' END"
_MANY = "CASE WHEN l_suppkey % 2 = 0 THEN 'one' ELSE 'zero_or_more' END"
query(
    "ann_wiring",
    f"""WITH i AS (SELECT l_orderkey AS g, l_linenumber AS node, 'in' AS port, l_linenumber - 1 - l_suppkey % 2 AS sn, CASE WHEN l_partkey % 5 = 0 THEN 'other' ELSE 'result' END AS sp, {_TYPE} AS ty, {_CARD} AS ca FROM lineitem WHERE l_linenumber > 1),
o AS (SELECT l_orderkey AS g, l_linenumber AS node, min(({_OUT}, {_MANY})) AS o FROM lineitem WHERE l_quantity > 3 GROUP BY ALL), d AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS node, l_linenumber - 1 AS dep FROM lineitem),
x AS (SELECT i.*, o.g IS NULL AS no_node, d.g IS NULL AS no_edge, o.o[1] AS oty, o.o[2] AS oca FROM i LEFT JOIN o ON o.g = i.g AND o.node = sn LEFT JOIN d ON d.g = i.g AND d.node = i.node AND dep = sn),
f AS (SELECT *, CASE WHEN no_node THEN 'unknown source' WHEN no_edge THEN 'source is no declared dependency' WHEN sp = 'other' THEN 'source has no such port' WHEN oty <> ty THEN 'type does not fit' WHEN ca = 'one' AND oca <> 'one' AND ty <> 'ValueSet' THEN 'cardinality does not fit' END AS message FROM x)
SELECT 'wiring' AS rule, g || ':' || node || ':' || port AS key, message FROM f WHERE message IS NOT NULL""",
    lambda t: V.wiring(
        t.lineitem.where("l_linenumber > 1").selectExpr("l_orderkey AS g", "l_linenumber AS node", "'in' AS port", "l_linenumber - 1 - l_suppkey % 2 AS source_node", "if(l_partkey % 5 = 0, 'other', 'result') AS source_port", f"{_TYPE} AS type", f"{_CARD} AS cardinality"),
        t.lineitem.where("l_quantity > 3").selectExpr("l_orderkey AS g", "l_linenumber AS node", "'result' AS port", f"{_OUT} AS type", f"{_MANY} AS cardinality"),
        t.lineitem.selectExpr("l_orderkey AS g", "l_linenumber AS node", "l_linenumber - 1 AS depends_on"),
        ["g"],
    ),
)

# ---- groundings and review -------------------------------------------------------------------------------------

_MODALITY = "CASE l_suppkey % 4 WHEN 0 THEN 'table_header' WHEN 1 THEN 'cell_link' WHEN 2 THEN 'question_literal' ELSE 'unknown' END"
_BOUND = "CASE l_partkey % 4 WHEN 0 THEN 'table_column' WHEN 1 THEN 'dynamic' WHEN 2 THEN 'question_literal' ELSE 'table_scope' END"
query(
    "ann_binding_kinds",
    f"SELECT 'binding_kind' AS rule, l_orderkey || ':' || l_linenumber AS key, m || ' as ' || k AS message FROM (SELECT *, {_MODALITY} AS m, {_BOUND} AS k FROM lineitem) WHERE NOT ((m = 'table_header' AND k IN ('table_column', 'table_scope')) OR (m = 'cell_link' AND k = 'dynamic') OR (m = k))",
    lambda t: V.binding_kinds(t.lineitem.selectExpr("*", f"{_MODALITY} AS m", f"{_BOUND} AS k"), ["l_orderkey", "l_linenumber"], "m", "k"),
)
query(
    "ann_groundings",
    """WITH b AS (SELECT l_orderkey AS g, l_linenumber % 4 AS node, count(*) AS c, bool_and(l_tax > 0.01) AS a FROM lineitem GROUP BY ALL), n AS (SELECT DISTINCT o_orderkey AS g, unnest(range(1, 4)) AS node FROM orders), f AS (SELECT DISTINCT o_orderkey AS g FROM orders WHERE o_orderstatus = 'F'),
x AS (SELECT g, node, n.g IS NOT NULL AS known, c, a, g IN (FROM f) AS claimed FROM (SELECT *, g AS g0 FROM n) n FULL JOIN b USING (g, node)),
w AS (SELECT *, 'unknown node' AS message FROM x WHERE NOT known UNION ALL SELECT *, 'several bindings' FROM x WHERE c > 1 UNION ALL SELECT *, 'no binding' FROM x WHERE known AND claimed AND c IS NULL UNION ALL SELECT *, 'slots left open' FROM x WHERE known AND claimed AND NOT a)
SELECT 'grounding' AS rule, g || ':' || node AS key, message FROM w""".replace("n.g IS NOT NULL AS known", "g0 IS NOT NULL AS known"),
    lambda t: V.groundings(
        t.lineitem.selectExpr("l_orderkey AS g", "l_linenumber % 4 AS node", "if(l_tax > 0.01, 'all_required_slots_grounded', 'some') AS coverage"),
        t.orders.selectExpr("o_orderkey AS g", "explode(sequence(1, 3)) AS node"),
        t.orders.selectExpr("o_orderkey AS g", "if(o_orderstatus = 'F', 'fully_grounded', 'partial') AS status"),
        ["g"],
    ),
)

_STATE = "CASE o_custkey % 5 WHEN 0 THEN 'llm_proposed' WHEN 1 THEN 'human_single_review' WHEN 2 THEN 'human_double_review_unadjudicated' WHEN 3 THEN 'adjudicated' ELSE 'draft' END"
_BUNDLE = "CASE o_orderkey % 4 WHEN 0 THEN 'human_reviewed' WHEN 1 THEN 'adjudicated' WHEN 2 THEN 'rejected' END"
_CASES = {
    "gold_claimed": "o_totalprice > 400000",
    "reviewer_without_id": "named < rows",
    "reviewer_repeated": "people < named",
    "count_disagrees": "c IS DISTINCT FROM people",
    "state_disagrees": "(s = 'llm_proposed' AND c > 0) OR (s = 'human_single_review' AND c <> 1) OR (s IN ('human_double_review_unadjudicated', 'adjudicated') AND c < 2)",
    "adjudication_missing": "s = 'adjudicated' AND o_orderstatus <> 'F'",
    "bundle_without_review": "c = 0 AND u IN ('human_reviewed', 'adjudicated')",
    "bundle_of_unreviewed": "s = 'llm_proposed' AND u IN ('human_reviewed', 'adjudicated')",
    "bundle_of_adjudicated": "s = 'adjudicated' AND (u IS NULL OR u = 'human_reviewed')",
}
query(
    "ann_review_states",
    f"WITH n AS (SELECT l_orderkey AS o_orderkey, count(*) AS rows, count(r) AS named, count(DISTINCT r) AS people FROM (SELECT l_orderkey, nullif(l_suppkey, 3) AS r FROM lineitem WHERE l_quantity > 25) GROUP BY 1), x AS (SELECT o.o_orderkey, o_totalprice, o_orderstatus, {_STATE} AS s, o_custkey % 4 AS c, {_BUNDLE} AS u, coalesce(rows, 0) AS rows, coalesce(named, 0) AS named, coalesce(people, 0) AS people FROM orders o LEFT JOIN n USING (o_orderkey)) "
    + " UNION ALL ".join(f"SELECT 'review_status' AS rule, o_orderkey::VARCHAR AS key, '{name}' AS message FROM x WHERE {test}" for name, test in _CASES.items()),
    lambda t: V.review_states(
        t.orders.selectExpr("o_orderkey", f"{_STATE} AS state", "o_totalprice > 400000 AS gold_claimed", "o_custkey % 4 AS human_review_count", "o_orderstatus = 'F' AS has_adjudication", f"{_BUNDLE} AS bundle_status"),
        t.lineitem.where("l_quantity > 25").selectExpr("l_orderkey AS o_orderkey", "nullif(l_suppkey, 3) AS reviewer_id"),
        "o_orderkey",
    ),
)

# ---- plans -----------------------------------------------------------------------------------------------------

NATIONS = ["n_nationkey", "n_name", "n_regionkey"]


def nation_plan(region: int) -> dict:
    """Rows of the nations named by those of a region: each name leads to one row."""
    nodes = [
        node("a", "FILTER", "table.filter", "RowSet", {"table": "$t"}, predicate=is_(NATIONS, "n_regionkey", "numeric_eq", region)),
        node("b", "PROJECT", "table.project", "ValueSet", {"rows": "a"}, column=column(NATIONS, "n_name"), mode="text", cardinality="many"),
        node("c", "JOIN", "table.join", "RowSet", {"rows": "$t", "key": "b"}, right_column=column(NATIONS, "n_name"), match="normalized"),
        node("d", "PROJECT", "table.project", "ValueSet", {"rows": "c"}, column=column(NATIONS, "n_nationkey"), mode="text", cardinality="many"),
    ]
    return plan("nation", NATIONS, nodes, "d")


def selection_plan(tie_policy: str, mode: str = "max") -> dict:
    """The documents of good label with the extreme number in their text."""
    nodes = [
        node("a", "FILTER", "table.filter", "RowSet", {"table": "$t"}, predicate=is_(LABELS, "quality", "numeric_eq", 1)),
        node("b", "PROJECT", "table.project", "EntitySet", {"rows": "a"}, column=column(LABELS, "doc_id"), mode="links", cardinality="many"),
        node("c", "RETRIEVE", "document.retrieve", "DocumentSet", {"entities": "b"}),
        node("d", "EXTRACT", "document.extract", "ValueSet", {"documents": "c"}, attribute="amount", value_type="Number", cardinality="many"),
        node("e", "COMPARE", "calculator.compare", "Entity" if tie_policy == "error" else "EntitySet", {"values": "d"}, relation=mode, **{"return": "selection"}, tie_policy=tie_policy, parse="Number"),
    ]
    return plan("labels", LABELS, nodes, "e")


query("plan_join", "SELECT n_nationkey::VARCHAR AS value FROM nation WHERE n_regionkey = 1", lambda t: compile_plan(nation_plan(1), {"nation": t.nation}))
query(
    "plan_selection",
    r"WITH x AS (SELECT d.doc_id, unnest(regexp_extract_all(text, '[-+]?[0-9]+(?:\.[0-9]+)?'))::DOUBLE AS v FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1) SELECT DISTINCT doc_id::VARCHAR AS value FROM x WHERE v = (SELECT max(v) FROM x)",
    lambda t: compile_plan(selection_plan("all"), {"labels": t.labels}, documents(t)),
)
query("q_retrieve_all", "SELECT doc_id AS value, length(text) AS n FROM labels JOIN documents USING (doc_id)", lambda t: R.retrieve_all(t.labels.select(F.col("doc_id").alias("value")), documents(t)).select("value", F.length("text").cast("long").alias("n")))
