"""The catalogue's fourth part: views, packets, rates of agreement and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import agreement as G
from .operators import views as W
from .queries import query

query("view_allowed", "SELECT page_id, url, 'train' AS role FROM pages", lambda t: W.allowed(t.pages, ["page_id", "url"], role="train"))
_SHOWN = {"O": ["o_custkey"], "F": ["o_custkey", "o_orderpriority"]}
query(
    "view_staged",
    """SELECT o_orderkey, o_orderstatus AS stage, CASE o_orderstatus WHEN 'O' THEN '{"o_custkey":' || o_custkey || '}' ELSE '{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}' END AS view FROM orders WHERE o_orderstatus IN ('O', 'F')""",
    lambda t: W.staged(t.orders, "o_orderkey", "o_orderstatus", _SHOWN),
)
query(
    "view_aliased",
    "SELECT conv_id, turn, 'observation_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS alias FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)",
    lambda t: W.aliased(t.conversations, ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "alias"),
)
query(
    "view_steps",
    "SELECT conv_id, 's' || turn AS step, CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN 's' || max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS depends_on FROM conversations",
    lambda t: W.steps_to_edges(t.conversations.withColumn("step", F.concat(F.lit("s"), "turn")), ["conv_id"], "turn", "step"),
)
query(
    "view_blinded",
    "WITH x AS (SELECT *, ('0x' || substr(sha256(p_partkey::VARCHAR), 1, 2))::INT % 2 = 0 AS f FROM part) SELECT p_partkey, CASE WHEN f THEN p_name ELSE p_brand END AS left, CASE WHEN f THEN p_brand ELSE p_name END AS right FROM x",
    lambda t: W.blinded(t.part, "p_partkey", "p_name", "p_brand"),
)
_VIEW = """'{"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}'"""
query(
    "view_packets",
    f"SELECT c_custkey % 4 AS partition, c_custkey, {_VIEW} AS view FROM customer",
    lambda t: W.packets(t.customer, t.customer.selectExpr("c_custkey", "c_custkey % 4 AS partition"), "c_custkey", ["c_nationkey", "c_mktsegment"]),
)
query(
    "view_bound_packets",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN sha256('{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') END AS assessment_sha256 FROM customer""",
    lambda t: W.bound_packets(t.customer.select("c_custkey"), t.customer.where("c_custkey % 3 = 0"), "c_custkey", ["c_nationkey", "c_mktsegment"]),
)
query(
    "view_context_signature",
    "SELECT c_custkey, concat_ws('|', 'segment=' || nullif(c_mktsegment, 'BUILDING'), 'nation=' || c_nationkey) AS sig FROM customer",
    lambda t: t.customer.select("c_custkey", W.context_signature(segment=F.expr("nullif(c_mktsegment, 'BUILDING')"), nation=F.col("c_nationkey")).alias("sig")),
)
query(
    "view_attempts",
    """WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(*) FILTER (l_returnflag = 'R') AS s, max(l_linenumber) FILTER (l_returnflag = 'R') AS a FROM lineitem WHERE l_linenumber < 4 GROUP BY 1)
SELECT 'attempts' AS rule, l_orderkey::VARCHAR AS key, 'not numbered 1 to n' AS message FROM g WHERE lo <> 1 OR hi <> n OR d <> n UNION ALL SELECT 'attempts', l_orderkey::VARCHAR, 'last attempt only is submitted' FROM g WHERE s <> 1 OR a <> hi""",
    lambda t: W.attempts(t.lineitem.where("l_linenumber < 4").withColumn("submitted", F.col("l_returnflag") == "R"), "l_orderkey", "l_linenumber", "submitted"),
)
query(
    "agr_match_rates",
    """WITH a AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 3 AS i FROM lineitem WHERE l_quantity < 30), b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 3 AS i FROM lineitem WHERE l_quantity > 20),
j AS (SELECT k, count(*) AS u, count(*) FILTER (x AND y) AS n FROM (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS x, b.k IS NOT NULL AS y FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i) GROUP BY k), s AS (SELECT CASE WHEN k % 5 = 0 THEN 'challenge' ELSE 'control' END AS stratum, u, n FROM j)
SELECT coalesce(stratum, 'all') AS stratum, count(*) AS pairs, round(avg((u = n)::INT), 6) AS exact, round(avg(round(n / u, 9)), 6) AS jaccard FROM s GROUP BY ROLLUP (stratum)""",
    lambda t: W.match_rates(
        G.jaccard(*[t.lineitem.where(w).selectExpr("l_orderkey AS k", "l_suppkey % 3 AS i") for w in ("l_quantity < 30", "l_quantity > 20")], ["k"], "i").withColumn("stratum", F.expr("if(k % 5 = 0, 'challenge', 'control')")),
        "stratum",
    ),
)
query(
    "report_markdown",
    """WITH g AS (SELECT l_returnflag AS flag, count(*) AS n, avg(l_quantity::DOUBLE) AS quantity FROM lineitem GROUP BY 1), r AS (SELECT 1 + row_number() OVER (ORDER BY flag) AS position, '| ' || flag || ' | ' || n || ' | ' || printf('%.3f', quantity) || ' |' AS value FROM g)
SELECT 0 AS position, '| flag | n | quantity |' AS value UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL FROM r""",
    lambda t: W.markdown(t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.avg(F.col("l_quantity").cast("double")).alias("quantity")), ["flag"]),
)
