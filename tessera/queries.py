"""The query catalogue: each operator on the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import agreement as G
from .operators import environment as E
from .operators import families as A
from .operators import graphs as N
from .operators import relational as R
from .operators import rules as V
from .operators import sampling as L
from .plans.compile import compile_plan
from .streaming.novelty import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None, made: Callable[[Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: made(Tables(spark, folder))
    if sql:
        ORACLE_SQL[name] = sql


def one(df: DataFrame, column: str = "value", digits: int | None = None) -> DataFrame:
    return df.select(F.round(column, digits).alias(column)) if digits is not None else df


# ---- plans -----------------------------------------------------------------------------------------------------


def node(id_: str, operator: str, tool: str, kind: str, inputs: dict, **arguments) -> dict:
    refs = {r: {"kind": "source", "source_id": v[1:]} if v[0] == "$" else {"kind": "node", "node_id": v, "port": "result"} for r, v in inputs.items()}
    return {"id": id_, "operator": operator, "inputs": refs, "arguments": arguments, "output": {"port": "result", "type": kind}, "tool_binding": tool}


def plan(table_id: str, columns: list[str], nodes: list[dict], answer: str) -> dict:
    return {
        "ir_version": "0.2", "graph_id": f"{table_id}-{answer}", "question_ref": {"question_id": table_id, "question": f"about {table_id}"},
        "schema_ref": {"table_id": table_id, "columns": [{"index": i, "label": c} for i, c in enumerate(columns)]},
        "sources": {"t": {"type": "Table", "locator": {"kind": "hybrid_table", "table_id": table_id}}}, "nodes": nodes, "answer": {"kind": "node", "node_id": answer, "port": "result"},
    }


LABELS, PARTS, SUPPLIERS = ["doc_id", "quality", "toxic"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def column(columns: list[str], label: str) -> dict:
    return {"index": columns.index(label), "label": label}


def is_(columns: list[str], label: str, kind: str, value) -> dict:
    return {"kind": kind, "column": column(columns, label), **({"values": value} if kind == "in" else {"value": value})}


def flagship_plan() -> dict:
    """How many numbers the documents hold that are labelled good and not toxic."""
    c = LABELS
    return plan("labels", c, [
        node("n1", "FILTER", "table.filter", "RowSet", {"table": "$t"}, predicate=is_(c, "quality", "numeric_eq", 1)),
        node("n2", "FILTER", "table.filter", "RowSet", {"rows": "n1"}, predicate=is_(c, "toxic", "numeric_eq", 0)),
        node("n3", "PROJECT", "table.project", "EntitySet", {"rows": "n2"}, column=column(c, "doc_id"), mode="links", cardinality="many"),
        node("n4", "RETRIEVE", "document.retrieve", "DocumentSet", {"entities": "n3"}),
        node("n5", "EXTRACT", "document.extract", "ValueSet", {"documents": "n4"}, attribute="amount", value_type="Number", cardinality="many"),
        node("n6", "AGGREGATE", "calculator.aggregate", "Number", {"values": "n5"}, function="count"),
    ], "n6")


def documents(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("document_id"), "text")


NUMBER = R.READERS["Number"]
query("plan_flagship", f"SELECT sum(len(regexp_extract_all(d.text, '{NUMBER}')))::DOUBLE AS value FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1 AND toxic = 0", lambda t: compile_plan(flagship_plan(), {"labels": t.labels}, documents(t)))
query(
    "plan_table_lookup",
    "SELECT min(p_name) AS value FROM part WHERE contains(p_type, 'SMALL') AND p_size > 40 GROUP BY lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g')))",
    lambda t: compile_plan(plan("part", PARTS, [
        node("a", "FILTER", "table.filter", "RowSet", {"table": "$t"}, predicate=is_(PARTS, "p_type", "contains", "SMALL")),
        node("b", "FILTER", "table.filter", "RowSet", {"rows": "a"}, predicate=is_(PARTS, "p_size", "numeric_gt", 40)),
        node("c", "PROJECT", "table.project", "ValueSet", {"rows": "b"}, column=column(PARTS, "p_name"), mode="text", cardinality="many"),
        node("d", "DISTINCT", "calculator.distinct", "ValueSet", {"values": "c"}, normalization="casefold_trim"),
    ], "d"), {"part": t.part}),
)
query(
    "plan_document_qa", r"SELECT unnest(regexp_extract_all(d.text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS value FROM labels l JOIN documents d USING (doc_id) WHERE quality = 0",
    lambda t: compile_plan(plan("labels", LABELS, [
        node("a", "FILTER", "table.filter", "RowSet", {"table": "$t"}, predicate=is_(LABELS, "quality", "numeric_eq", 0)),
        node("b", "PROJECT", "table.project", "EntitySet", {"rows": "a"}, column=column(LABELS, "doc_id"), mode="links", cardinality="many"),
        node("c", "RETRIEVE", "document.retrieve", "DocumentSet", {"entities": "b"}),
        node("d", "EXTRACT", "document.extract", "ValueSet", {"documents": "c"}, attribute="email of the author", value_type="String", cardinality="many"),
    ], "d"), {"labels": t.labels}, documents(t)),
)
query(
    "plan_calculate", "SELECT round(max(s_acctbal) - min(s_acctbal), 6) AS value FROM supplier",
    lambda t: one(compile_plan(plan("supplier", SUPPLIERS, [
        node("a", "PROJECT", "table.project", "ValueSet", {"table": "$t"}, column=column(SUPPLIERS, "s_acctbal"), mode="text", cardinality="many"),
        node("b", "PARSE", "calculator.parse", "ValueSet", {"values": "a"}, target_type="Number"),
        node("c", "AGGREGATE", "calculator.aggregate", "Number", {"values": "b"}, function="max"),
        node("d", "AGGREGATE", "calculator.aggregate", "Number", {"values": "b"}, function="min"),
        node("e", "ARITHMETIC", "calculator.arithmetic", "Number", {"left": "c", "right": "d"}, function="subtract"),
    ], "e"), {"supplier": t.supplier}), digits=6),
)
query(
    "plan_arg_extreme", "SELECT arg_max(s_name, s_acctbal) AS value FROM supplier",
    lambda t: compile_plan(plan("supplier", SUPPLIERS, [
        node("a", "ARG_EXTREME", "table.arg_extreme", "Row", {"table": "$t"}, column=column(SUPPLIERS, "s_acctbal"), mode="max", parse="Number", tie_policy="error"),
        node("b", "PROJECT", "table.project", "String", {"row": "a"}, column=column(SUPPLIERS, "s_name"), mode="text", cardinality="one"),
    ], "b"), {"supplier": t.supplier}),
)

# ---- query operators -------------------------------------------------------------------------------------------

query("q_filter_eq", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", lambda t: R.filter_rows(t.customer, "c_mktsegment", "eq", "BUILDING").select("c_custkey"))
query("q_filter_contains", "SELECT p_partkey FROM part WHERE contains(p_type, 'ROM')", lambda t: R.filter_rows(t.part, "p_type", "contains", "ROM").select("p_partkey"))
query("q_filter_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')", lambda t: R.filter_rows(t.orders, "o_orderstatus", "in", ["F", "P"]).select("o_orderkey"))
query("q_filter_numeric_gt", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45", lambda t: R.filter_rows(t.lineitem, "l_quantity", "numeric_gt", 45).select("l_orderkey", "l_linenumber"))
query("q_filter_numeric_lt", "SELECT c_custkey FROM customer WHERE c_acctbal < 0", lambda t: R.filter_rows(t.customer, "c_acctbal", "numeric_lt", 0).select("c_custkey"))
query("q_filter_numeric_eq", "SELECT p_partkey FROM part WHERE p_size = 7", lambda t: R.filter_rows(t.part, "p_size", "numeric_eq", 7).select("p_partkey"))
query("q_project_text_many", "SELECT n_name AS value FROM nation", lambda t: R.project(t.nation, "n_name"))
query("q_project_one_guard", "SELECT n_name AS value FROM nation WHERE n_nationkey = 3", lambda t: R.project(t.nation.where("n_nationkey = 3"), "n_name", cardinality="one"))
query("q_project_links", "SELECT doc_id AS value FROM labels", lambda t: R.project(t.labels.withColumn("l", F.array("doc_id")), "l", "links"))
query("q_retrieve", "SELECT doc_id AS value, length(text) AS n FROM labels JOIN documents USING (doc_id)", lambda t: R.retrieve(t.labels.select(F.col("doc_id").alias("value")), documents(t)).select("value", F.length("text").cast("long").alias("n")))
query("q_retrieve_missing", "SELECT DISTINCT user_id AS value FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", lambda t: R.missing_documents(t.events.select(F.col("user_id").alias("value")).distinct(), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("text"))))
query("q_extract_number", f"SELECT doc_id, len(regexp_extract_all(text, '{NUMBER}')) AS n, list_max(list_transform(regexp_extract_all(text, '{NUMBER}'), lambda x: x::DOUBLE)) AS most FROM documents",
      lambda t: t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)).alias("v")).select("doc_id", F.size("v").cast("long").alias("n"), F.array_max(F.transform("v", R.to_number)).alias("most")))
query("q_extract_date", "SELECT o_orderkey, x AS value FROM (SELECT o_orderkey, unnest(regexp_extract_all('due ' || strftime(o_orderdate, '%Y-%m-%d') || ', at the latest on ' || strftime(o_orderdate, '%Y-%m-') || '31', '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS x FROM orders) WHERE try_cast(x AS DATE) IS NOT NULL",
      lambda t: R.extract_by(t.orders.select("o_orderkey", F.concat(F.lit("due "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", at the latest on "), F.date_format("o_orderdate", "yyyy-MM-"), F.lit("31")).alias("text")), "o_orderkey", "day", "Date").select("o_orderkey", F.col("value").cast("string").alias("value")))
query("q_extract_email", r"SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS value FROM documents", lambda t: t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(R.READERS["email"]), F.lit(0))).alias("value")))
query("q_select_sentence", r"SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda x: trim(x)), lambda x: x <> '')) AS n_sentences, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda x: trim(x)), lambda x: x <> '')[1] AS first, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda x: trim(x)), lambda x: x <> '')[3] AS third FROM documents",
      lambda t: t.documents.select("doc_id", R.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.try_element_at("s", F.lit(1)).alias("first"), F.try_element_at("s", F.lit(3)).alias("third")))
query("q_join_key", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", lambda t: R.join_rows(t.orders, "o_custkey", t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("value"))).select("o_orderkey"))
query("q_join_ambiguous", "SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY o_custkey HAVING count(*) > 1", lambda t: R.ambiguous_keys(t.orders, "o_custkey"))
for f, sql in (("count", "count(l_quantity)::DOUBLE"), ("sum", "sum(l_quantity)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)"), ("average", "avg(l_quantity)")):
    query(f"q_aggregate_{f}", f"SELECT round({sql}, 6) AS value FROM lineitem", lambda t, f=f: one(R.aggregate(t.lineitem.select(F.col("l_quantity").alias("value")), f), digits=6))
query("q_compare_pair", "SELECT o_orderkey, o_totalprice > c_acctbal AS value FROM orders JOIN customer ON c_custkey = o_custkey", lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", R.compare(F.col("o_totalprice"), F.col("c_acctbal"), "gt").alias("value")))
query("q_compare_keyed", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) = 1", lambda t: R.keyed_extreme(t.customer, ["c_nationkey"], "c_custkey", "c_acctbal"))
query("q_parse_number", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events", lambda t: t.events.select("event_id", R.to_number(F.get_json_object("props", "$.k")).alias("value")))
query("q_parse_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders", lambda t: t.orders.select("o_orderkey", R.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("string").alias("value")))
query("q_parse_failures", "SELECT source, count(*) AS n FROM documents WHERE try_cast(text AS DOUBLE) IS NULL GROUP BY source", lambda t: t.documents.where(R.to_number(F.col("text")).isNull()).groupBy("source").agg(F.count("*").alias("n")))
query("q_arg_max_row", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC LIMIT 1", lambda t: R.arg_extreme(t.supplier, F.col("s_acctbal")).select("s_suppkey", "s_acctbal"))
query("q_arg_extreme_ties", "SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)", lambda t: R.keyed_extreme(t.part.withColumn("g", F.lit(1)), ["g"], "p_partkey", "p_size").select("p_partkey", "p_size"))
query("q_arith_ratio", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS value FROM lineitem", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", R.arithmetic(F.col("l_extendedprice"), F.col("l_quantity"), "divide").alias("value")))
query("q_date_diff_days", "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey", lambda t: t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", R.date_difference(F.to_date("l_shipdate"), F.to_date("o_orderdate"), "day").alias("value")))
query("q_distinct_norm", "SELECT min(p_type) AS value FROM part GROUP BY lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g')))", lambda t: R.distinct_values(t.part.select(F.col("p_type").alias("value")), "casefold_trim"))

# ---- families --------------------------------------------------------------------------------------------------

SEQ = """WITH ev AS (SELECT *, ts::DATE AS day, lag(event_type) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS before FROM events),
f AS (SELECT user_id, day, user_id % 5 AS part, string_agg(event_type, '>' ORDER BY ts, event_id) AS fine, string_agg(event_type, '>' ORDER BY ts, event_id) FILTER (before IS DISTINCT FROM event_type) AS contracted, count(*)::VARCHAR AS topology, count(*)::INT AS n FROM ev GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY day, user_id) AS position, contracted AS sig FROM f),
c AS (SELECT sig, count(*) AS n FROM r GROUP BY sig)
"""


def seq(t: Tables, sig: str = "contracted") -> DataFrame:
    return A.event_sequences(t.events).withColumn("sig", F.col(sig))


PREFIX = 100
query("fam_counts", SEQ + "SELECT sig, n FROM c", lambda t: A.counts(seq(t)))
query("fam_positions", SEQ + "SELECT user_id, day::VARCHAR AS day, position, fine FROM r", lambda t: seq(t).select("user_id", F.col("day").cast("string").alias("day"), "position", "fine"))
query("fam_singleton_mass", SEQ + "SELECT sum(n)::BIGINT AS records, count(*) AS families, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n = 2) AS doubletons, round(count(*) FILTER (n = 1) / sum(n), 9) AS singleton_mass FROM c", lambda t: A.summary(A.counts(seq(t))))
query("fam_topk_coverage", SEQ + ", k AS (SELECT *, row_number() OVER (ORDER BY n DESC, sig) AS rank FROM c) SELECT u.k::INT AS k, round(sum(n) FILTER (rank <= u.k) / (SELECT sum(n) FROM c), 9) AS coverage FROM k, (VALUES (1), (5), (10), (20)) u(k) GROUP BY u.k", lambda t: A.topk_coverage(A.counts(seq(t))))
query("fam_contracted", SEQ + "SELECT user_id, day::VARCHAR AS day, contracted, n FROM r", lambda t: seq(t).select("user_id", F.col("day").cast("string").alias("day"), "contracted", "n"))
query("fam_topology", SEQ + "SELECT topology AS sig, count(*) AS n FROM r GROUP BY topology", lambda t: A.counts(seq(t), "topology"))
query("fam_rarefaction", SEQ + """, t AS (SELECT sum(n)::BIGINT AS total FROM c), s AS (SELECT DISTINCT s FROM (SELECT unnest(range(10, total + 1, 10)) AS s FROM t UNION ALL SELECT total FROM t))
SELECT s, round(sum(1 - CASE WHEN total - n < s THEN 0 ELSE list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, n), lambda i: (total - s - i)::DOUBLE / (total - i))), lambda a, b: a * b) END), 4) AS expected FROM c, t, s GROUP BY s""", lambda t: A.rarefaction(A.counts(seq(t))))
query("fam_cumulative_curve", SEQ + ", b AS (SELECT sig, min(position) AS first FROM r GROUP BY sig), e AS (SELECT max(position) AS position FROM r GROUP BY (position - 1) // 10) SELECT position, (SELECT count(*) FROM b WHERE first <= position) AS families FROM e", lambda t: A.cumulative_curve(seq(t)))
query("fam_block_novelty", SEQ + ", b AS (SELECT sig, (position - 1) // 10 + 1 AS block, min((position - 1) // 10 + 1) OVER (PARTITION BY sig) AS first FROM r) SELECT block, count(*) AS records, count(*) FILTER (first = block) AS novel_records, count(DISTINCT sig) FILTER (first = block) AS new_families FROM b GROUP BY block", lambda t: A.block_novelty(seq(t)))
query("fam_sequential_vs_baseline", SEQ + f", b AS (SELECT sig, position, (position - 1) // 10 + 1 AS block, min((position - 1) // 10 + 1) FILTER (position > {PREFIX}) OVER (PARTITION BY sig) AS first, min(position) OVER (PARTITION BY sig) <= {PREFIX} AS known FROM r) SELECT block, count(*) FILTER (NOT known AND first = block) AS sequential, count(*) FILTER (NOT known) AS baseline FROM b WHERE position > {PREFIX} GROUP BY block", lambda t: A.sequential_and_baseline(seq(t), PREFIX))
query("fam_transfer", SEQ + f", b AS (SELECT sig IN (SELECT sig FROM r WHERE position <= {PREFIX}) AS hit FROM r WHERE position > {PREFIX}) SELECT count(*) AS expansion, count(*) FILTER (hit) AS transferred, round(count(*) FILTER (hit) / count(*), 9) AS rate FROM b", lambda t: A.transfer(seq(t), PREFIX))
query("fam_absorption", SEQ + f", b AS (SELECT * FROM r WHERE position > {PREFIX} AND fine NOT IN (SELECT fine FROM r WHERE position <= {PREFIX})) SELECT count(*) AS novel_fine, count(*) FILTER (contracted IN (SELECT contracted FROM r WHERE position <= {PREFIX})) AS absorbed, round(count(*) FILTER (contracted IN (SELECT contracted FROM r WHERE position <= {PREFIX})) / count(*), 9) AS rate FROM b", lambda t: A.absorption(seq(t), "fine", "contracted", PREFIX))
query("fam_partition_support", SEQ + f", g AS (SELECT sig, min(position) AS first, count(*) AS n_records, count(DISTINCT part) AS n_parts, count(DISTINCT (position - 1) // 10) AS n_blocks FROM r GROUP BY sig) SELECT sig, n_records, n_parts, n_blocks, n_records >= 3 AND n_parts >= 2 AND n_blocks >= 2 AS material FROM g WHERE first > {PREFIX} AND n_records >= 2", lambda t: A.partition_support(seq(t), PREFIX))
query("fam_dominant_inflation", SEQ + ", a AS (SELECT topology AS fine_sig, count(*) AS fine_n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), b AS (SELECT part::VARCHAR AS coarse_sig, count(*) AS coarse_n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) SELECT fine_sig, fine_n, coarse_sig, coarse_n, (SELECT count(*) FROM r WHERE part::VARCHAR = coarse_sig AND topology <> fine_sig) AS added FROM a, b", lambda t: A.dominant_inflation(seq(t).withColumn("part", F.col("part").cast("string")), "topology", "part"))
query("fam_partition_profile", SEQ + "SELECT part, count(*) AS n_records, min(position) AS first, max(position) AS last, round(avg(n), 9) AS mean_steps FROM r GROUP BY part", lambda t: A.partition_profile(seq(t)))
query("fam_crosswalk", SEQ + "SELECT topology AS coarse, 'contracted' AS kind, contracted AS sig, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT topology, 'part', part::VARCHAR, count(*) FROM r GROUP BY ALL", lambda t: A.crosswalk(seq(t).withColumn("part", F.col("part").cast("string")), "topology", {"contracted": "contracted", "part": "part"}))
query("stream_windowed_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL", lambda t: windowed_counts(t.events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"))

# ---- sampling --------------------------------------------------------------------------------------------------

HASH = "sha256('seed' || chr(0) || {0}::VARCHAR)"
query("samp_hash_rank_topk", f"SELECT c_custkey, {HASH.format('c_custkey')} AS rank_hash FROM customer ORDER BY 2, 1 LIMIT 50", lambda t: L.top_by_hash(t.customer.select("c_custkey"), "c_custkey", "seed", 50))
query("samp_role_split", f"WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY {HASH.format('c_custkey')}, c_custkey) AS rank FROM customer) SELECT c_custkey, rank::INT AS rank, CASE WHEN rank <= 10 THEN 'pilot' WHEN rank <= 70 THEN 'train' WHEN rank <= 90 THEN 'dev' ELSE 'locked' END AS role FROM k WHERE rank <= 110", lambda t: L.role_split(t.customer, "c_custkey", "seed", [("pilot", 10), ("train", 60), ("dev", 20), ("locked", 20)]))
query("samp_disjoint_proof", "WITH a AS (SELECT doc_id FROM labels WHERE toxic = 1), b AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS n_source, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (FROM a) AND doc_id NOT IN (FROM b)) AS n_uncovered, (SELECT count(DISTINCT doc_id) FROM a WHERE doc_id IN (FROM b)) AS n_shared, 0::BIGINT AS n_foreign", lambda t: L.disjoint_proof(t.labels, {"toxic": t.labels.where("toxic = 1"), "low": t.labels.where("quality = 0")}, "doc_id"))
query("samp_exposed_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", lambda t: L.exposed_anti_join(t.documents.select("doc_id"), t.labels, "doc_id"))
query("samp_round_robin", "SELECT c_custkey, (row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1) % 5 + 4 AS lane FROM customer", lambda t: A.positions(t.customer.select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey").select("c_custkey", L.round_robin(F.col("position"), 5, 4).alias("lane")))
query("samp_balanced_pick", f"SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal < 0 DESC, {HASH.format('c_custkey')}, c_custkey)::INT AS pick FROM customer QUALIFY pick <= 4", lambda t: L.balanced_pick(t.customer.withColumn("flag", F.col("c_acctbal") < 0), "c_nationkey", "flag", "c_custkey", "seed", 4).select("c_nationkey", "c_custkey", "pick"))
query("samp_quota", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('seed' || chr(0) || p_brand || chr(0) || p_partkey::VARCHAR), p_partkey)::INT AS pick FROM part QUALIFY pick <= least(count(*) OVER (PARTITION BY p_brand), 1 + ceil(log2(count(*) OVER (PARTITION BY p_brand))))", lambda t: L.quota_pick(t.part, "p_brand", "p_partkey", "seed").select("p_brand", "p_partkey", "pick"))
query("samp_greedy_coverage", None, lambda t: L.greedy_coverage(t.part, "p_brand", "p_partkey", ["p_type", "p_size"], "seed"))

# ---- graphs: part keys in graphs of 64 (key 0 of each is the common sink only), k -> k/2 and the redundant k -> k/4 ------------------------------

ARCS = """WITH RECURSIVE k AS (SELECT p_partkey % 64 AS k, p_partkey // 64 AS g FROM part WHERE p_partkey % 64 > 0),
e AS (SELECT DISTINCT g AS graph_id, k AS src, k // 2 AS dst FROM k WHERE k > 1 UNION SELECT DISTINCT g, k, k // 4 FROM k WHERE k > 3),
p(graph_id, src, dst) AS (SELECT * FROM e UNION SELECT p.graph_id, p.src, e.dst FROM p JOIN e ON e.graph_id = p.graph_id AND e.src = p.dst)
"""


def arcs(t: Tables) -> DataFrame:
    k = t.part.where("p_partkey % 64 > 0").select((F.col("p_partkey") % 64).alias("k"), F.floor(F.col("p_partkey") / 64).alias("graph_id"))
    half = lambda n: F.floor(F.col("k") / n)
    return k.select("graph_id", F.col("k").alias("src"), half(2).alias("dst")).where("src > 1").union(k.where("k > 3").select("graph_id", "k", half(4))).distinct()


def ring(t: Tables) -> DataFrame:
    """The arcs and, in each graph, one back from 1 to 5."""
    e = arcs(t)
    return e.union(e.select("graph_id", F.lit(1).cast("long"), F.lit(5).cast("long")).distinct())


def labels_of(t: Tables) -> DataFrame:
    return N.nodes_of(arcs(t)).withColumn("label", F.concat(F.lit("L"), F.col("node") % 3))


query("g_closure", ARCS + "SELECT DISTINCT * FROM p", lambda t: N.closure(arcs(t)))
query("g_reduction", ARCS + "SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e a JOIN p ON p.graph_id = a.graph_id AND p.src = a.dst WHERE a.graph_id = e.graph_id AND a.src = e.src AND p.dst = e.dst)", lambda t: N.reduction(arcs(t), N.closure(arcs(t))))
query("g_removed_edges", ARCS + "SELECT graph_id, count(*) AS n FROM e WHERE EXISTS (SELECT 1 FROM e a JOIN p ON p.graph_id = a.graph_id AND p.src = a.dst WHERE a.graph_id = e.graph_id AND a.src = e.src AND p.dst = e.dst) GROUP BY graph_id", lambda t: N.removable(arcs(t), N.closure(arcs(t))).groupBy("graph_id").agg(F.count("*").alias("n")))
query("g_depth", ARCS + ", d(graph_id, node, depth) AS (SELECT graph_id, src, 1 FROM e UNION SELECT graph_id, dst, 1 FROM e UNION SELECT e.graph_id, e.dst, d.depth + 1 FROM d JOIN e ON e.graph_id = d.graph_id AND e.src = d.node) SELECT graph_id, node, max(depth) AS depth FROM d GROUP BY ALL", lambda t: N.depths(arcs(t)))
query("g_degree_profile", ARCS + ", d AS (SELECT graph_id, src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT graph_id, dst, 0, 1 FROM e) SELECT graph_id, node, sum(i)::BIGINT AS indegree, sum(o)::BIGINT AS outdegree FROM d GROUP BY ALL", lambda t: N.degrees(arcs(t)))
query("g_roots_sinks", ARCS + ", d AS (SELECT graph_id, src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT graph_id, dst, 0, 1 FROM e), s AS (SELECT graph_id, node, sum(i) AS i, sum(o) AS o FROM d GROUP BY ALL) SELECT graph_id, count(*) FILTER (i = 0) AS roots, count(*) FILTER (o = 0) AS sinks, count(*) FILTER (o > 1) AS branches, count(*) FILTER (i > 1) AS joins FROM s GROUP BY graph_id",
      lambda t: N.degrees(arcs(t)).groupBy("graph_id").agg(F.expr("count_if(indegree = 0)").alias("roots"), F.expr("count_if(outdegree = 0)").alias("sinks"), F.expr("count_if(outdegree > 1)").alias("branches"), F.expr("count_if(indegree > 1)").alias("joins")))
query("g_live_dead", ARCS + ", n AS (SELECT graph_id, src AS node FROM e UNION SELECT graph_id, dst FROM e) SELECT graph_id, node, node = 5 OR EXISTS (SELECT 1 FROM p WHERE p.graph_id = n.graph_id AND p.src = n.node AND p.dst = 5) AS live FROM n", lambda t: N.live_nodes(arcs(t), N.closure(arcs(t)), arcs(t).select("graph_id", F.lit(5).cast("long").alias("node")).distinct()))
query("g_scc", ARCS.replace("p(graph_id", "x AS (SELECT * FROM e UNION SELECT DISTINCT graph_id, 1, 5 FROM e),\np(graph_id").replace("SELECT * FROM e UNION SELECT p.graph_id, p.src, e.dst FROM p JOIN e", "SELECT * FROM x UNION SELECT p.graph_id, p.src, e.dst FROM p JOIN x e") + "SELECT a.graph_id, min(b.src) AS component, a.src AS node FROM p a JOIN p b ON b.graph_id = a.graph_id AND b.src = a.dst AND b.dst = a.src GROUP BY a.graph_id, a.src", lambda t: N.cyclic_components(N.closure(ring(t))))
query("g_transitions", ARCS + "SELECT 'L' || src % 3 AS from_label, 'L' || dst % 3 AS to_label, count(*) AS n FROM e GROUP BY ALL", lambda t: N.transitions(arcs(t), labels_of(t)))
query("g_rules", ARCS.replace("p(graph_id", "x AS (SELECT * FROM e UNION SELECT DISTINCT graph_id, 1, 5 FROM e),\np(graph_id").replace("SELECT * FROM e UNION SELECT p.graph_id, p.src, e.dst FROM p JOIN e", "SELECT * FROM x UNION SELECT p.graph_id, p.src, e.dst FROM p JOIN x e") + "SELECT 'cycle' AS rule, graph_id || ':' || src AS key, 'on a cycle' AS message FROM p WHERE src = dst UNION ALL SELECT DISTINCT 'unknown_label', graph_id || ':' || n, 'L2' FROM (SELECT graph_id, src AS n FROM e UNION SELECT graph_id, dst FROM e) WHERE n % 3 = 2", lambda t: V.graph_rules(labels_of(t), ring(t), N.closure(ring(t)), ["L0", "L1"]))
query("g_canonical", None, lambda t: N.signatures(A.event_sequences(t.events).select(F.concat_ws(":", "user_id", "day").alias("graph_id"), F.posexplode("steps").alias("node", "label")), A.event_sequences(t.events).select(F.concat_ws(":", "user_id", "day").alias("graph_id"), F.explode(F.filter(F.transform("steps", lambda s, i: F.struct((i - 1).alias("src"), i.alias("dst"))), lambda e: e["src"] >= 0)).alias("e")).select("graph_id", "e.src", "e.dst")))

# ---- agreement -------------------------------------------------------------------------------------------------

DAYS = """a AS (SELECT DISTINCT user_id, ts::DATE AS item FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id, ts::DATE AS item FROM events WHERE event_type = 'click'),
s AS (SELECT user_id, count(*) FILTER (x) AS n_left, count(*) FILTER (y) AS n_right, count(*) FILTER (x AND y) AS n_both FROM (SELECT user_id, item, bool_or(x) AS x, bool_or(y) AS y FROM (SELECT *, true AS x, false AS y FROM a UNION ALL SELECT *, false, true FROM b) GROUP BY ALL) GROUP BY user_id)"""


def two_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Days on which a user bought, and clicked."""
    days = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("item"))
    return days("purchase"), days("click")


query("agr_jaccard", f"WITH {DAYS} SELECT *, round(coalesce(n_both / nullif(n_left + n_right - n_both, 0), 1), 9) AS jaccard FROM s", lambda t: G.jaccard(*two_sets(t), ["user_id"], "item"))
query("agr_dice", f"WITH {DAYS} SELECT *, round(coalesce(2 * n_both / nullif(n_left + n_right, 0), 1), 9) AS dice FROM s", lambda t: G.dice(*two_sets(t), ["user_id"], "item"))
query("agr_crosstab", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL", lambda t: G.crosstab(t.labels, "quality", "toxic"))
query("agr_purity", "WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT p_type, max(n) AS m, sum(n) AS n FROM c GROUP BY p_type), t AS (SELECT sum(m) / sum(n) AS p, count(*) AS k, count(*) FILTER (n = 1) AS o, sum(n) AS n FROM s), b AS (SELECT max(n) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY p_brand)) SELECT k AS signatures, round(p, 9) AS purity, round(b / n, 9) AS baseline, round((p - b / n) / (1 - b / n), 9) AS lift, round(o / k, 9) AS singletons FROM t, b", lambda t: G.purity(t.part, "p_type", "p_brand"))
query("agr_pair_rate", "SELECT round(avg((quality = 1 - toxic)::INT), 9) AS rate FROM labels", lambda t: t.labels.agg(G.pair_rate(F.col("quality"), 1 - F.col("toxic")).alias("rate")))
query("agr_stability", "WITH m AS (SELECT user_id % 10 AS family, ts::DATE AS member, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS h FROM events GROUP BY ALL) SELECT family, count(*) AS members, count(DISTINCT h) AS profiles, count(DISTINCT h) = 1 AS stable FROM m GROUP BY family", lambda t: G.stability(t.events.select((F.col("user_id") % 10).alias("family"), F.to_date("ts").alias("member"), "event_type"), "family", "member", "event_type"))
query("agr_coverage_sym", "WITH c AS (SELECT lang, count(*) AS n, count(quality) FILTER (quality = 1) AS q, count(quality) AS k, count(toxic) FILTER (toxic = 0) AS x FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, round(2 * (q / k) * (x / n) / (q / k + x / n), 9) AS coverage FROM c", lambda t: t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.expr("count_if(quality = 1)").alias("q"), F.count("quality").alias("k"), F.expr("count_if(toxic = 0)").alias("x")).select("lang", G.symmetric_coverage(F.col("q"), F.col("k"), F.col("x"), F.col("n")).alias("coverage")))
query("agr_review_aggregation", "SELECT conv_id, count(DISTINCT role) AS reviewers, count(DISTINCT md5(text)) AS versions, count(DISTINCT role) >= 2 AS observed, count(DISTINCT md5(text)) > 1 AS disagree FROM conversations GROUP BY conv_id", lambda t: t.conversations.groupBy("conv_id").agg(F.countDistinct("role").alias("reviewers"), F.countDistinct(F.md5("text")).alias("versions")).withColumns({"observed": F.col("reviewers") >= 2, "disagree": F.col("versions") > 1}))

# ---- environment, rules, functions -------------------------------------------------------------------------------

CELLS = "WITH c AS (SELECT doc_id AS row_index, 0 AS column_index, 'doc_id' AS label, doc_id::VARCHAR AS text FROM labels UNION ALL SELECT doc_id, 1, 'quality', quality::VARCHAR FROM labels UNION ALL SELECT doc_id, 2, 'toxic', toxic::VARCHAR FROM labels) "


def label_cells(t: Tables) -> DataFrame:
    return E.cells(t.labels, F.col("doc_id"), LABELS, {"doc_id": F.array(F.col("doc_id").cast("string"))})


query("env_cells", CELLS + "SELECT * FROM c", lambda t: label_cells(t).drop("links"))
query("env_schema_view", CELLS + "SELECT column_index, label, count(*) AS n_cells, count(*) FILTER (coalesce(trim(text), '') = '') AS n_blank, label = 'doc_id' AS has_links FROM c GROUP BY ALL", lambda t: E.schema_view(label_cells(t)))
query("env_link_closure", "SELECT l.doc_id::VARCHAR AS document_id, count(*) AS n_links, bool_or(d.doc_id IS NOT NULL) AS found FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en' GROUP BY 1", lambda t: E.link_closure(label_cells(t), t.documents.where("lang = 'en'").select(F.col("doc_id").alias("document_id"))))
query("env_contiguous", "SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS d, min(turn) AS lo, max(turn) AS hi FROM conversations WHERE turn <> 1 GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)", lambda t: E.non_contiguous(t.conversations.where("turn <> 1"), "conv_id", "turn"))
query("rule_duplicate_ids", "SELECT 'duplicate_id' AS rule, l_orderkey::VARCHAR AS key, count(*) || ' rows' AS message FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1", lambda t: V.duplicate_ids(t.lineitem, "l_orderkey"))
query("rule_dangling_refs", "SELECT 'dangling_ref' AS rule, o_custkey::VARCHAR AS key, count(*) || ' references' AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey", lambda t: V.dangling_refs(t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey"))
query("rule_exact_ids", "SELECT 'exact_ids' AS rule, doc_id::VARCHAR AS key, CASE WHEN l IS NULL THEN 'missing' ELSE 'extra' END AS message FROM (SELECT doc_id, 1 AS l FROM labels) FULL JOIN (SELECT doc_id, 1 AS d FROM documents WHERE lang = 'en') USING (doc_id) WHERE l IS NULL OR d IS NULL", lambda t: V.exact_ids(t.labels, t.documents.where("lang = 'en'"), "doc_id"))
query("rule_multiset_cover", "WITH h AS (SELECT o_orderpriority AS i, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), w AS (SELECT o_orderpriority AS i, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT 'multiset' AS rule, i AS key, coalesce(h.n, 0) || ' of ' || coalesce(w.n, 0) AS message FROM h FULL JOIN w USING (i) WHERE coalesce(h.n, 0) <> coalesce(w.n, 0)", lambda t: V.multiset_cover(t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_orderstatus = 'O'"), "o_orderpriority"))
query("rule_span_match", "SELECT 'span' AS rule, p_partkey::VARCHAR AS key, substr(p_name, 2, 4) AS message FROM part WHERE substr(p_name, 2, 4) <> substr(p_type, 2, 4)", lambda t: V.span_match(t.part.select("p_partkey", "p_name", F.lit(1).alias("a"), F.lit(5).alias("b"), F.substring("p_type", 2, 4).alias("s")), "p_partkey", "p_name", "a", "b", "s"))
query("rule_forbidden_keys", "SELECT 'forbidden_key' AS rule, event_id::VARCHAR AS key, k AS message FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) WHERE regexp_replace(lower(k), '[^a-z0-9]', '', 'g') IN ('k', 'answer')", lambda t: V.forbidden_keys(t.events, "event_id", "props", ["k", "answer"]))
query("hash_set", "SELECT n_regionkey, sha256(string_agg(DISTINCT n_name, chr(10) ORDER BY n_name) || chr(10)) AS h FROM nation GROUP BY 1", lambda t: t.nation.groupBy("n_regionkey").agg(G.set_hash(F.col("n_name")).alias("h")))
query("hash_canonical_json", """SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS h FROM region""", lambda t: t.region.select("r_regionkey", X.canonical_hash(F.col("r_name"), F.col("r_regionkey")).alias("h")))
query("hash_side", "SELECT c_custkey, CASE WHEN ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 2))::INT % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM customer", lambda t: t.customer.select("c_custkey", X.hash_side(F.col("c_custkey")).alias("side")))
query("case_tier_stratum", "WITH g AS (SELECT l_partkey % 300 * (l_partkey % 7) AS g, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT -1 - p_partkey, 1 + p_partkey % 130 FROM part) SELECT g, n, CASE WHEN n = 1 THEN 'singleton' WHEN n = 2 THEN 'doubleton' ELSE 'recurrent' END AS tier, CASE WHEN n = 1 THEN 'singleton_1' WHEN n = 2 THEN 'doubleton_2' WHEN n <= 9 THEN 'low_recurrent_3_9' WHEN n <= 19 THEN 'medium_recurrent_10_19' WHEN n <= 99 THEN 'high_recurrent_20_99' ELSE 'dominant_100_plus' END AS stratum FROM g", lambda t: t.lineitem.groupBy((F.col("l_partkey") % 300 * (F.col("l_partkey") % 7)).alias("g")).agg(F.count("*").alias("n")).union(t.part.select(-1 - F.col("p_partkey"), 1 + F.col("p_partkey") % 130)).withColumns({"tier": X.evidence_tier(F.col("n")), "stratum": X.frequency_stratum(F.col("n"))}))
query("json_pointer_get", "SELECT event_id, json_extract_string(props, '/k') AS value FROM events", lambda t: t.events.select("event_id", X.json_pointer(F.col("props"), "/k").alias("value")))
query("fence_strip", "SELECT event_id, props AS value FROM events", lambda t: t.events.select("event_id", X.strip_fence(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("value")))
query("key_canonical", "SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS k FROM nation", lambda t: t.nation.select("n_nationkey", X.canonical_key(F.col("n_name")).alias("k")))

# queries of record joins, decisions, semantics and JSON walks
from . import queries_records  # noqa: E402, F401
from . import queries_annotation  # noqa: E402, F401
from . import queries_views  # noqa: E402, F401
