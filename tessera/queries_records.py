"""The catalogue's second part: decisions, record joins and sets, semantics of candidates, JSON walks, text tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import json_walk as J
from .functions import text as X
from .operators import decisions as D
from .operators import families as A
from .operators import graphs as N
from .operators import records as K
from .operators import semantics as S
from .queries import ARCS, PREFIX, SEQ, Tables, arcs, labels_of, query, seq

# ---- families and decisions ------------------------------------------------------------------------------------

OTHER = "contains(fine, 'error>error')"


def flagged(t: Tables) -> DataFrame:
    return seq(t).withColumn("other", F.contains("fine", F.lit("error>error")))


_MASS = "(SELECT count(*) FILTER (n = 1) / sum(n) FROM c)"
_OTHER = f"(SELECT avg(({OTHER})::INT) FROM r)"
_BLOCKS = "bn AS (SELECT sig, (position - 1) // 10 + 1 AS block, min((position - 1) // 10 + 1) OVER (PARTITION BY sig) AS first FROM r), nb AS (SELECT block, count(*) FILTER (first = block) / count(*) AS rate FROM bn GROUP BY block)"
query(
    "fam_expand_decision",
    SEQ + f""", {_BLOCKS}, l AS (SELECT min(rate) AS least, count(*) AS k FROM (FROM nb ORDER BY block DESC LIMIT 2)),
w AS (SELECT count(*) AS k FROM (SELECT sig FROM r WHERE position > {PREFIX} AND sig NOT IN (SELECT sig FROM r WHERE position <= {PREFIX}) GROUP BY sig HAVING count(*) >= 2)),
x AS (SELECT {_MASS} > 0.10 AS singleton_mass, {_OTHER} > 0.05 AS other_rate, l.k = 2 AND least > 0.10 AS last_blocks, w.k >= 2 AS recurring FROM l, w)
SELECT *, CASE WHEN singleton_mass OR other_rate OR last_blocks OR recurring THEN 'EXPAND_UNCHANGED_TO_N300' ELSE 'FREEZE_CANDIDATE_LIBRARY_AND_BEGIN_REPRESENTATIVE_ENVIRONMENT_REALIZATION' END AS decision FROM x""",
    lambda t: D.first_expansion(flagged(t), PREFIX),
)
_YES, _NO = "EXPAND_UNCHANGED_TO_N1000", "FREEZE_CANDIDATE_BACKBONE_LIBRARY_AND_BEGIN_REPRESENTATIVE_ENVIRONMENT_REALIZATION"
query(
    "fam_n1000_decision",
    SEQ + f""", e AS (SELECT sig, part, (position - 1) // 10 + 1 AS block, min((position - 1) // 10 + 1) OVER (PARTITION BY sig) AS first FROM r WHERE position > {PREFIX} AND sig NOT IN (SELECT sig FROM r WHERE position <= {PREFIX})),
b AS (SELECT DISTINCT (position - 1) // 10 + 1 AS block FROM r WHERE position > {PREFIX} ORDER BY block DESC LIMIT 5),
l AS (SELECT (SELECT count(*) FROM e WHERE block IN (FROM b) AND first = block) AS new, (SELECT count(DISTINCT sig) FROM e WHERE block IN (FROM b) AND first = block) AS families, (SELECT count(*) FROM r WHERE position > {PREFIX} AND (position - 1) // 10 + 1 IN (FROM b)) AS n),
m AS (SELECT count(*) AS k FROM (SELECT sig FROM e GROUP BY sig HAVING count(*) >= 3 AND count(DISTINCT part) >= 2 AND count(DISTINCT block) >= 2)),
x AS (SELECT {_MASS} > 0.05 AS singleton_mass, {_OTHER} > 0.05 AS other_rate, new / n > 0.10 AND families >= 2 AS tail_novelty, k >= 2 AS material, round(new / n, 9) AS tail_rate FROM l, m)
SELECT *, CASE WHEN singleton_mass OR other_rate OR tail_novelty OR material THEN '{_YES}' ELSE '{_NO}' END AS decision FROM x""",
    lambda t: D.second_expansion(flagged(t), PREFIX, _YES, _NO),
)
query("fam_tail_blocks", SEQ + f", {_BLOCKS} SELECT block, round(rate, 9) AS rate FROM nb ORDER BY block DESC LIMIT 5", lambda t: A.tail_blocks(A.block_novelty(seq(t)), 5).select("block", F.round(F.col("novel_records") / F.col("records"), 9).alias("rate")))
query("fam_examples", SEQ + "SELECT sig, list(user_id ORDER BY position)[1:3]::VARCHAR AS examples FROM r GROUP BY sig", lambda t: A.examples(seq(t), "sig", "user_id").select("sig", F.concat(F.lit("["), F.array_join("examples", ", "), F.lit("]")).alias("examples")))
query("fam_top", SEQ + ", k AS (SELECT row_number() OVER (ORDER BY n DESC, sig)::INT AS rank, sig, n FROM c QUALIFY rank <= 20) SELECT rank, sig, n, (SELECT list(user_id ORDER BY position)[1:3]::VARCHAR FROM r WHERE r.sig = k.sig) AS examples FROM k", lambda t: A.top_families(seq(t), "sig", "user_id").select("rank", "sig", "n", F.concat(F.lit("["), F.array_join("examples", ", "), F.lit("]")).alias("examples")))
query("fam_prefix_summaries", SEQ + ", p AS (SELECT p AS prefix, sig, count(*) AS n FROM r, (VALUES (30), (100), (300)) v(p) WHERE position <= p GROUP BY ALL) SELECT prefix, sum(n)::BIGINT AS records, count(*) AS families, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n = 2) AS doubletons, round(count(*) FILTER (n = 1) / sum(n), 9) AS singleton_mass FROM p GROUP BY prefix", lambda t: A.prefix_summaries(seq(t), (30, 100, 300)))
query("fam_record_profile", """SELECT count(*) AS records, '{' || (SELECT string_agg('"' || s || '":' || n, ',' ORDER BY s) FROM (SELECT event_type AS s, count(*) AS n FROM events GROUP BY 1)) || '}' AS status_counts, count(*) FILTER (value > 90) AS uncertain, round(count(*) FILTER (value > 90) / count(*), 9) AS uncertain_rate, count(*) FILTER (user_id = 1) AS other, round(count(*) FILTER (user_id = 1) / count(*), 9) AS other_rate, round(avg(user_id), 9) AS mean_nodes FROM events""", lambda t: A.record_profile(t.events, "event_type", F.col("value") > 90, F.col("user_id") == 1, F.col("user_id")))
query(
    "fam_library",
    SEQ + f"""SELECT sig, count(*) AS n, min(position) AS first, max(position) AS last, count(DISTINCT part) AS n_parts, count(DISTINCT (position - 1) // 10) AS n_blocks, count(DISTINCT fine) AS n_fine, count(DISTINCT topology) AS n_topology, count(*) FILTER (position <= {PREFIX}) AS in_prefix,
CASE WHEN count(*) = 1 THEN 'singleton' WHEN count(*) = 2 THEN 'doubleton' ELSE 'recurrent' END AS tier, CASE WHEN count(*) = 1 THEN 'singleton_1' WHEN count(*) = 2 THEN 'doubleton_2' WHEN count(*) <= 9 THEN 'low_recurrent_3_9' WHEN count(*) <= 19 THEN 'medium_recurrent_10_19' WHEN count(*) <= 99 THEN 'high_recurrent_20_99' ELSE 'dominant_100_plus' END AS stratum,
least(count(*), 1 + ceil(log2(count(*))))::BIGINT AS quota, count(*) FILTER (position <= {PREFIX}) = 0 AS new FROM r GROUP BY sig""",
    lambda t: A.family_library(seq(t), PREFIX),
)


def counted(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey", "p_partkey % 2 as a", "p_size % 3 as b", "least(14, p_partkey % 16) as c", "least(least(14, p_partkey % 16), p_size % 16) as d", "p_partkey % 3 as e", "p_size / 50.0 as r")


_COUNTED = "WITH k AS (SELECT p_partkey, p_partkey % 2 AS a, p_size % 3 AS b, least(14, p_partkey % 16) AS c, least(14, p_partkey % 16, p_size % 16) AS d, p_partkey % 3 AS e, p_size / 50.0 AS r FROM part) SELECT p_partkey, "
query("dec_normalization", _COUNTED + "CASE WHEN a > 0 OR b > 1 THEN 'REVISE_NORMALIZATION_CONTRACT_TECHNICAL_OR_SEMANTIC_LOSS' WHEN e <> 0 THEN 'RUN_PRECOMMITTED_CROSSED_AUTHOR_SENSITIVITY' WHEN r > 0.5 OR c / 14 > 0.6 THEN 'REVISE_NORMALIZATION_CONTRACT_THRESHOLD_FAILURE' ELSE 'ALLOW_PROVISIONAL_NON_FINAL_GROUNDING_ADAPTER' END AS decision FROM k", lambda t: counted(t).select("p_partkey", D.normalization_branch(F.col("a"), F.col("b"), F.col("r"), F.col("c") / 14, F.col("e") == 0, {"technical_loss": 0, "not_equivalent": 1, "provisional": 0.5, "unstable": 0.6}).alias("decision")))
query("dec_crossed", _COUNTED + "CASE WHEN a <= 0 AND b <= 1 AND r <= 0.9 AND c >= 4 AND d >= 2 THEN 'FREEZE' ELSE 'REVISE_EQUIVALENCE_NORMALIZATION_CONTRACT' END AS decision FROM k", lambda t: counted(t).select("p_partkey", D.crossed_branch({"a": 0, "b": 1, "r": 0.9}, {"c": 4, "d": 2}, "FREEZE", "REVISE_EQUIVALENCE_NORMALIZATION_CONTRACT").alias("decision")))
query("dec_staged", _COUNTED + "CASE WHEN NOT (a <= 0 AND b = 1) THEN 'technical' WHEN NOT c >= 4 THEN 'coverage' WHEN NOT (d >= 2 AND r >= 0.3) THEN 'semantic' ELSE 'pass' END AS decision FROM k", lambda t: counted(t).select("p_partkey", D.staged_branch(D.within({"a": 0}, equal={"b": 1}), D.within(least={"c": 4}), D.within(least={"d": 2, "r": 0.3}), ("technical", "coverage", "semantic", "pass")).alias("decision")))
query("dec_grounding", _COUNTED + "CASE WHEN a > 0 THEN 'STOP_TECHNICAL_OR_LEAKAGE_FAILURE' WHEN b > 0 THEN 'BLOCKED_PINNED_ENVIRONMENT_UNAVAILABLE' WHEN c <> 14 THEN 'INCOMPLETE_GROUNDING_COLLECTION' WHEN d <> 14 OR e > 0 THEN 'REVIEW_AMBIGUITY_OR_COVERAGE_BEFORE_EXECUTION_PLAN' ELSE 'FREEZE_GROUNDING_EVIDENCE_FOR_SEPARATE_EXECUTION_PLAN' END AS decision FROM k", lambda t: counted(t).select("p_partkey", D.grounding_branch(*[F.col(c) for c in "abcde"]).alias("decision")))

# ---- joins, sets, aggregates -----------------------------------------------------------------------------------

query("rec_positional_join", "SELECT c_custkey, c_name, c_acctbal FROM customer", lambda t: K.positional_join(t.customer.select("c_custkey", "c_nationkey", "c_name"), t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey", "c_nationkey").select("c_custkey", "c_name", "c_acctbal"))
query("rec_checked_join", "SELECT l.doc_id, CASE WHEN v.doc_id IS NULL THEN 'no_view' ELSE 'quality_differs' END AS rule FROM labels l LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS q FROM labels WHERE toxic = 0) v USING (doc_id) WHERE v.doc_id IS NULL OR q <> quality", lambda t: K.checked_join(t.labels, t.labels.where("toxic = 0").withColumn("quality", F.expr("case when doc_id % 7 = 0 then 1 - quality else quality end")), "doc_id", ["quality"]))
query("rec_crossed", "SELECT n_nationkey AS nation, s AS segment, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = s AND c_acctbal > 5000) AS n FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer)", lambda t: K.crossed(t.nation.select(F.col("n_nationkey").alias("nation")), t.customer.select(F.col("c_mktsegment").alias("segment")).distinct(), t.customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), ["nation", "segment"]))
query("rec_three_way", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)", lambda t: K.three_way(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), t.labels.select("doc_id", "toxic"), "doc_id"))
query("rec_triggered", "SELECT 'low' AS rule, doc_id FROM labels WHERE quality = 0 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT 'both', doc_id FROM labels WHERE quality = 0 AND toxic = 1", lambda t: K.triggered(t.labels, "doc_id", {"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "both": (F.col("quality") == 0) & (F.col("toxic") == 1)}))
query("rec_default_status", "SELECT c_custkey, coalesce(s, CASE WHEN c_acctbal < 0 THEN 'technical_invalid' ELSE 'not_delivered' END) AS status FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, min(o_orderstatus) AS s FROM orders WHERE o_totalprice > 200000 GROUP BY 1) USING (c_custkey)", lambda t: K.with_default_status(t.customer.select("c_custkey", "c_acctbal"), t.orders.where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("status")), ["c_custkey"], "status", F.col("c_acctbal") < 0).select("c_custkey", "status"))
query("rec_one_to_one", "SELECT k, count(*) FILTER (l) AS n_left, count(*) FILTER (NOT l) AS n_right FROM (SELECT c_custkey AS k, true AS l FROM customer UNION ALL SELECT o_custkey, false FROM orders) GROUP BY k HAVING count(*) FILTER (l) <> 1 OR count(*) FILTER (NOT l) <> 1", lambda t: K.one_to_one(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"]))
query("rec_first_present", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'd' || doc_id ELSE 'x' || doc_id END AS id FROM documents", lambda t: K.first_present(t.documents.selectExpr("doc_id", "case when lang = 'en' then 'd' || doc_id else ' ' end as question_id", "'x' || doc_id as qid"), ["question_id", "qid"]).select("doc_id", "id"))
query("set_loss", "WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 30), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.05) SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS kept, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS lost, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS gained", lambda t: K.set_loss(t.lineitem.where("l_quantity > 30"), t.lineitem.where("l_discount > 0.05"), ["l_partkey", "l_suppkey"]))
query("set_conflicts", "SELECT l_orderkey, l_returnflag, count(*) AS n_rows, count(DISTINCT l_linestatus) AS n_versions, count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY ALL", lambda t: K.conflicts(t.lineitem, ["l_orderkey", "l_returnflag"], "l_linestatus"))
query("set_shared_by_all", "SELECT g, event_type FROM (SELECT user_id % 40 AS g, event_type, count(DISTINCT user_id) AS m FROM events WHERE value > 40 GROUP BY ALL) JOIN (SELECT user_id % 40 AS g, count(DISTINCT user_id) AS n FROM events WHERE value > 40 GROUP BY 1) USING (g) WHERE m = n", lambda t: K.shared_by_all(t.events.where("value > 40").withColumn("g", F.col("user_id") % 40), "g", "user_id", "event_type"))
query("set_union_ids", "SELECT c_custkey::VARCHAR AS id FROM customer UNION SELECT o_custkey::VARCHAR FROM orders UNION SELECT user_id::VARCHAR FROM events", lambda t: K.union_ids([t.customer.select(F.col("c_custkey").alias("i")), t.orders.select(F.col("o_custkey").alias("i")), t.events.select(F.col("user_id").alias("i"))], "i"))
query("set_prefix_proof", "SELECT count(*) AS n_prefix, count(*) FILTER (event_type <> 'error') AS n_equal, count(*) FILTER (event_type = 'error') AS n_different FROM events WHERE event_id < 100", lambda t: K.prefix_proof(t.events.select("event_id", "event_type"), t.events.where("event_id < 100").select("event_id", F.regexp_replace("event_type", "error", "other").alias("event_type")), "event_id", "event_type"))
query("agg_distribution", "SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 9) AS mean, median(l_quantity) AS median, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1", lambda t: K.distribution(t.lineitem, "l_quantity", ["l_returnflag"]))
query("agg_multiset", """SELECT p_brand, '[' || string_agg('{"p_type":"' || p_type || '","count":' || n || '}', ',' ORDER BY p_type) || ']' AS items FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1""", lambda t: K.multiset(t.part, ["p_brand"], ["p_type"]))
query("agg_code_counts", "SELECT event_type AS rule, count(*) AS n FROM events GROUP BY 1", lambda t: K.code_counts(t.events.withColumn("rule", F.col("event_type"))))
query("agg_by_subset", "SELECT coalesce(l_returnflag, 'all') AS subset, count(*) AS n, round(avg(l_quantity), 9) AS quantity, round(avg((l_discount > 0.05)::INT), 9) AS cheap FROM lineitem GROUP BY ROLLUP (l_returnflag)", lambda t: K.by_subset(t.lineitem, "l_returnflag", {"quantity": F.col("l_quantity"), "cheap": (F.col("l_discount") > 0.05).cast("double")}))
query("agg_last_of", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT AS back FROM events QUALIFY back <= 2", lambda t: K.last_of(t.events, "user_id", "event_id", 2).select("user_id", "event_id", "back"))
_STATUS = "CASE WHEN l_quantity > 48 THEN 'adequate' WHEN l_quantity > 40 THEN 'partially_adequate' WHEN l_quantity > 20 THEN 'indeterminate' ELSE 'inadequate' END"
query("rule_adequacy", f"WITH s AS (SELECT l_orderkey, {_STATUS} AS s FROM lineitem), g AS (SELECT l_orderkey, CASE WHEN bool_or(s = 'adequate') THEN 'adequate' WHEN bool_or(s = 'partially_adequate') THEN 'partially_adequate' WHEN bool_or(s = 'indeterminate') THEN 'indeterminate' ELSE 'inadequate' END AS status FROM s GROUP BY 1) SELECT l_orderkey, status, CASE status WHEN 'adequate' THEN true WHEN 'indeterminate' THEN NULL ELSE false END AS adequate FROM g", lambda t: K.adequacy(t.lineitem.withColumn("s", F.expr(_STATUS)), "l_orderkey", "s"))
query("rule_sums", "SELECT o_orderkey, 1 + o_orderkey % 4 AS total, coalesce(n, 0) AS parts FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey) WHERE 1 + o_orderkey % 4 <> coalesce(n, 0)", lambda t: K.sum_mismatches(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("one")), t.orders.select("o_orderkey", (1 + F.col("o_orderkey") % 4).alias("total_")), "o_orderkey", "one", "total_"))

# ---- semantics: the arcs as target, node k realised by operators k % 20 and, for every fifth node, k % 11 + 20 ----------------

_MAP = ARCS.rstrip("\n") + """,
n AS (SELECT graph_id, src AS node FROM e UNION SELECT graph_id, dst FROM e),
m AS (SELECT graph_id, node, node % 20 AS op FROM n WHERE node % 13 > 0 UNION SELECT graph_id, node, node % 11 + 20 FROM n WHERE node % 5 = 0),
oe AS (SELECT DISTINCT graph_id, src AS a, dst AS b FROM e WHERE src < 32),
q(graph_id, a, b) AS (SELECT * FROM oe UNION SELECT q.graph_id, q.a, oe.b FROM q JOIN oe ON oe.graph_id = q.graph_id AND oe.a = q.b),
h AS (SELECT DISTINCT x.graph_id, x.node AS src, y.node AS dst FROM m x JOIN m y ON y.graph_id = x.graph_id AND x.node <> y.node WHERE x.op = y.op OR EXISTS (SELECT 1 FROM q WHERE q.graph_id = x.graph_id AND q.a = x.op AND q.b = y.op)),
d AS (SELECT graph_id, src, dst, 'preserved' AS kind FROM (FROM p INTERSECT FROM h) UNION ALL SELECT graph_id, src, dst, 'missing' FROM (SELECT * FROM p WHERE src <> dst EXCEPT FROM h) UNION ALL SELECT graph_id, src, dst, 'extra' FROM (FROM h EXCEPT FROM p))
"""


def mapped(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = N.nodes_of(arcs(t))
    m = n.where("node % 13 > 0").select("graph_id", "node", (F.col("node") % 20).alias("operator"))
    m = m.union(n.where("node % 5 = 0").select("graph_id", "node", F.col("node") % 11 + 20)).distinct()
    return m, N.closure(arcs(t).where("src < 32"))


query("sem_dependencies", _MAP + "SELECT * FROM d", lambda t: S.dependency_profile(N.closure(arcs(t)), *mapped(t)))
query("sem_precedes", _MAP + "SELECT * FROM e INTERSECT FROM h", lambda t: S.precedes(arcs(t), *mapped(t)))
query("sem_assessment", _MAP + """, u AS (SELECT graph_id, count(*) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.graph_id = n.graph_id AND m.node = n.node) GROUP BY 1), g AS (SELECT DISTINCT graph_id FROM n),
r AS (SELECT graph_id, coalesce(u.k, 0) AS uncovered, (SELECT count(*) FROM d WHERE d.graph_id = g.graph_id AND kind = 'missing') AS missing, (SELECT count(*) FROM d WHERE d.graph_id = g.graph_id AND kind = 'extra') AS extra FROM g LEFT JOIN u USING (graph_id))
SELECT *, CASE WHEN uncovered > 0 OR missing > 0 THEN 'not_equivalent' WHEN extra > 0 THEN 'provisionally_equivalent' ELSE 'equivalent' END AS status FROM r""",
      lambda t: S.assessment(N.nodes_of(arcs(t)), mapped(t)[0], S.dependency_profile(N.closure(arcs(t)), *mapped(t))))
query("sem_placement", ARCS + """, n AS (SELECT graph_id, src AS node FROM e UNION SELECT graph_id, dst FROM e), s AS (SELECT * FROM n WHERE node % 7 = 3)
SELECT graph_id, node, CASE WHEN b AND a THEN 'explicit_between_semantics' WHEN b THEN 'explicit_before_semantic' WHEN a THEN 'explicit_after_semantic' ELSE 'explicit_disconnected' END AS placement
FROM (SELECT n.*, EXISTS (SELECT 1 FROM p JOIN s ON s.graph_id = p.graph_id AND s.node = p.dst WHERE p.graph_id = n.graph_id AND p.src = n.node) AS b, EXISTS (SELECT 1 FROM p JOIN s ON s.graph_id = p.graph_id AND s.node = p.src WHERE p.graph_id = n.graph_id AND p.dst = n.node) AS a FROM n WHERE node % 4 = 0)""",
      lambda t: S.placement(N.nodes_of(arcs(t)).where("node % 4 = 0"), N.nodes_of(arcs(t)).where("node % 7 = 3"), N.closure(arcs(t))))
query("sem_mapped_profile", ARCS + "SELECT graph_id, count(*) AS edges, count(*) FILTER (src % 6 > 0 AND dst % 6 > 0) AS alignable, count(*) FILTER (src % 6 > 0 AND dst % 6 > 0 AND src // 3 = dst // 3) AS collapsed, count(DISTINCT CASE WHEN src % 6 > 0 AND dst % 6 > 0 AND src // 3 <> dst // 3 THEN (src // 3) * 1000 + dst // 3 END) AS projected FROM e GROUP BY graph_id", lambda t: S.mapped_profile(arcs(t), N.nodes_of(arcs(t)).where("node % 6 > 0").withColumn("group", F.floor(F.col("node") / 3))))
query("sem_graph_profile", ARCS + """, dg AS (SELECT graph_id, node, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT graph_id, src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT graph_id, dst, 0, 1 FROM e) GROUP BY ALL),
x(graph_id, node, depth) AS (SELECT graph_id, node, 1 FROM dg UNION SELECT e.graph_id, e.dst, x.depth + 1 FROM x JOIN e ON e.graph_id = x.graph_id AND e.src = x.node),
f AS (SELECT graph_id, depth, i, o, count(*) AS n FROM (SELECT graph_id, node, max(depth) AS depth FROM x GROUP BY ALL) JOIN dg USING (graph_id, node) GROUP BY ALL)
SELECT graph_id, sum(n)::BIGINT AS nodes, sha256(string_agg(l, ';' ORDER BY l)) AS profile_hash FROM (SELECT graph_id, n, depth || ':' || i || ':' || o || ':' || n AS l FROM f) GROUP BY graph_id""",
      lambda t: S.graph_profile(N.degrees(arcs(t)), N.depths(arcs(t))))
_ELIGIBLE = "CASE WHEN l_quantity < 5 OR l_discount > 0.09 THEN 'ineligible' WHEN l_tax > 0.06 THEN 'provisional_only' ELSE 'full_eligible' END"


def candidates(t: Tables) -> DataFrame:
    reasons = lambda *tests: F.array_compact(F.array(*[F.when(F.expr(x), x) for x in tests]))
    return t.lineitem.withColumn("status", S.eligibility(reasons("l_quantity < 5", "l_discount > 0.09"), reasons("l_tax > 0.06")))


query("sem_record_sets", f"WITH k AS (SELECT l_suppkey, {_ELIGIBLE} AS status, l_shipmode AS sig FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)) SELECT l_suppkey, count(*) AS candidates, count(*) FILTER (status = 'full_eligible') AS full_eligible, count(*) FILTER (status = 'provisional_only') AS provisional_only, count(*) FILTER (status = 'ineligible') AS ineligible, count(DISTINCT sig) FILTER (status = 'full_eligible') AS full_signatures, count(DISTINCT sig) FILTER (status = 'provisional_only') AS provisional_signatures, sha256(coalesce(string_agg(DISTINCT sig, chr(10) ORDER BY sig) FILTER (status = 'full_eligible'), '') || chr(10)) AS full_set_hash FROM k GROUP BY 1", lambda t: S.record_sets(candidates(t).withColumn("sig", F.concat("l_returnflag", "l_linestatus")), ["l_suppkey"], "status", "sig"))
query("sem_family_sets", "WITH s AS (SELECT o_custkey % 20 AS family, o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS a, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS b FROM orders GROUP BY ALL), r AS (SELECT family, 'a' AS component, a AS h FROM s UNION ALL SELECT family, 'b', b FROM s) SELECT family, component, count(*) AS questions, count(DISTINCT h) AS profiles, count(DISTINCT h) = 1 AS stable FROM r GROUP BY ALL", lambda t: S.family_sets(t.orders.groupBy((F.col("o_custkey") % 20).alias("family"), "o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("a"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("b")), "family", ["a", "b"]))
_ALIGN = "CASE l_linenumber % 4 WHEN 0 THEN 'partial_overlap' WHEN 1 THEN 'equivalent' WHEN 2 THEN 'compatible_split_merge' ELSE 'substantive_conflict' END"
query("sem_layer_coverage", f"""WITH g AS (SELECT l_orderkey, {_ALIGN} AS s, 1 + l_partkey % 2 AS l, 1 + l_suppkey % 3 AS r FROM lineitem WHERE l_quantity > 10), u AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS lu, count(*) FILTER (l_returnflag <> 'R') AS ru FROM lineitem WHERE l_quantity <= 10 GROUP BY 1),
a AS (SELECT l_orderkey, sum(l) AS la, sum(r) AS ra, sum(l) FILTER (s = 'equivalent') AS ls, sum(r) FILTER (s = 'equivalent') AS rs, sum(l) FILTER (s IN ('equivalent', 'compatible_split_merge')) AS lc, sum(r) FILTER (s IN ('equivalent', 'compatible_split_merge')) AS rc FROM g GROUP BY 1),
k AS (SELECT l_orderkey, coalesce(coalesce(ls, 0) / nullif(coalesce(la, 0) + coalesce(lu, 0), 0), 1) AS ls, coalesce(coalesce(lc, 0) / nullif(coalesce(la, 0) + coalesce(lu, 0), 0), 1) AS lc, coalesce(coalesce(rs, 0) / nullif(coalesce(ra, 0) + coalesce(ru, 0), 0), 1) AS rs, coalesce(coalesce(rc, 0) / nullif(coalesce(ra, 0) + coalesce(ru, 0), 0), 1) AS rc FROM a FULL JOIN u USING (l_orderkey))
SELECT l_orderkey, round(ls, 9) AS left_strict_coverage, round(lc, 9) AS left_compatible_coverage, round(rs, 9) AS right_strict_coverage, round(rc, 9) AS right_compatible_coverage, round(coalesce(2 * ls * rs / nullif(ls + rs, 0), 0), 9) AS symmetric_strict_coverage, round(coalesce(2 * lc * rc / nullif(lc + rc, 0), 0), 9) AS symmetric_compatible_coverage FROM k""",
      lambda t: S.layer_coverage(t.lineitem.where("l_quantity > 10").select("l_orderkey", F.expr(_ALIGN).alias("status"), (1 + F.col("l_partkey") % 2).alias("n_left"), (1 + F.col("l_suppkey") % 3).alias("n_right")), t.lineitem.where("l_quantity <= 10").select("l_orderkey", F.expr("if(l_returnflag = 'R', 'left', 'right')").alias("side")), "l_orderkey"))
query("sem_disposition", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'INDETERMINATE' WHEN p_size % 5 = 0 THEN 'SUBSTANTIVE_DISAGREEMENT' WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 AND p_size < 40 AND p_partkey % 2 = 0 THEN 'FULL_EQUIVALENCE' ELSE 'COMPATIBLE_VARIATION' END AS d FROM part", lambda t: t.part.select("p_partkey", S.question_disposition(F.col("p_size") % 7 == 0, F.col("p_size") % 5 == 0, F.col("p_size") % 2 == 0, F.col("p_partkey") % 3, F.col("p_size") < 40, F.col("p_partkey") % 2 == 0).alias("d")))
query("sem_structural_comparison", "WITH a AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal > 0 AS f FROM customer), b AS (SELECT c_custkey AS k, c_nationkey // 2 * 2 AS n, c_acctbal > 1000 AS f FROM customer) SELECT count(*) AS n, round(avg((a.n = b.n AND a.f = b.f)::INT), 9) AS exact, round(avg(abs(a.n - b.n)), 9) AS diff_n, round(avg((a.f = b.f)::INT), 9) AS same_f FROM a JOIN b USING (k)", lambda t: S.structural_comparison(t.customer.selectExpr("c_custkey as k", "c_nationkey as n", "c_acctbal > 0 as f"), t.customer.selectExpr("c_custkey as k", "c_nationkey div 2 * 2 as n", "c_acctbal > 1000 as f"), "k", ["n"], ["f"]))
query("g_contract_general", None, lambda t: N.contracted_graphs(labels_of(t), arcs(t)))

# ---- JSON of orders with their lines -----------------------------------------------------------------------------

_ORDERS = "WITH o AS (SELECT o_orderkey, o_orderstatus AS s, list(l_linenumber ORDER BY l_linenumber) AS ls FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) "


def order_json(t: Tables) -> DataFrame:
    """(o_orderkey, j): {"id", "Answers": {"status"}, "records": [{"qid", "note"}], "locked_eval": [..], "$ref"}."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("ls"))
    o = t.orders.join(lines, "o_orderkey")
    rows = F.transform("ls", lambda n: F.struct(F.concat(F.lit("q"), n.cast("string")).alias("qid"), F.lit("n").alias("note")))
    return o.select("o_orderkey", F.to_json(F.struct(
        F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status")).alias("Answers"), rows.alias("records"), F.transform("ls", lambda n: n * 10).alias("locked_eval"), F.lit("#/x").alias("$ref"),
    )).alias("j"))


def joined(c) -> DataFrame:
    return F.array_join(c, ",")


_LINES = "list_transform(range(0, len(ls)), lambda i: {0})"
query("json_key_paths", _ORDERS + f"SELECT o_orderkey, array_to_string(['$.id', '$.Answers', '$.Answers.status', '$.records'] || flatten({_LINES.format(chr(91) + chr(39) + '$.records[' + chr(39) + ' || i || ' + chr(39) + '].qid' + chr(39) + ', ' + chr(39) + '$.records[' + chr(39) + ' || i || ' + chr(39) + '].note' + chr(39) + chr(93))}) || ['$.locked_eval', '$.$ref'], ',') AS v FROM o", lambda t: order_json(t).select("o_orderkey", joined(J.key_paths(F.col("j"))).alias("v")))
query("json_key_set", _ORDERS + "SELECT o_orderkey, '$ref,Answers,id,locked_eval,note,qid,records,status' AS v FROM o", lambda t: order_json(t).select("o_orderkey", joined(J.key_set(F.col("j"))).alias("v")))
query("json_object_paths", _ORDERS + f"SELECT o_orderkey, array_to_string(list_sort(['$', '$.Answers'] || {_LINES.format(chr(39) + '$.records[' + chr(39) + ' || i || ' + chr(39) + ']' + chr(39))}), ',') AS v FROM o", lambda t: order_json(t).select("o_orderkey", joined(J.object_paths(F.col("j"))).alias("v")))
query("json_forbidden_paths", _ORDERS + f"SELECT o_orderkey, array_to_string(['$.Answers'] || {_LINES.format(chr(39) + '$.records[' + chr(39) + ' || i || ' + chr(39) + '].note' + chr(39))}, ',') AS v FROM o", lambda t: order_json(t).select("o_orderkey", joined(J.forbidden_paths(F.col("j"), ["answer", "NOTES"])).alias("v")))
query("json_sanitized", _ORDERS + """SELECT o_orderkey, '{"id":' || o_orderkey || ',"records":[' || array_to_string(list_transform(ls, lambda n: '{"qid":"q' || n || '"}'), ',') || '],"locked_eval":[' || array_to_string(list_transform(ls, lambda n: n * 10), ',') || '],"$ref":"#/x"}' AS v FROM o""", lambda t: order_json(t).select("o_orderkey", J.sanitized(F.col("j"), ["answer", "notes"]).alias("v")))
query("json_values", _ORDERS + """SELECT o_orderkey, '"' || s || '",' || array_to_string(list_transform(ls, lambda n: '"q' || n || '"'), ',') AS v FROM o""", lambda t: order_json(t).select("o_orderkey", joined(J.values_of(F.col("j"), ["status", "qid"])).alias("v")))
query("json_texts", _ORDERS + "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(ls, lambda n: 'q' || n))), ',') AS v FROM o", lambda t: order_json(t).select("o_orderkey", joined(J.texts_of(F.col("j"), "qid")).alias("v")))
query("json_explicit_ids", _ORDERS + "SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderkey::VARCHAR] || list_transform(ls, lambda n: 'q' || n) || list_transform(ls, lambda n: (n * 10)::VARCHAR))), ',') AS v FROM o", lambda t: order_json(t).select("o_orderkey", joined(J.explicit_ids(F.col("j"))).alias("v")))
query("json_locked_ids", _ORDERS + "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(ls, lambda n: (n * 10)::VARCHAR))), ',') AS v FROM o", lambda t: order_json(t).select("o_orderkey", joined(J.locked_ids(F.col("j"))).alias("v")))
query("json_refs", _ORDERS + "SELECT o_orderkey, '$.$ref' AS path, '#/x' AS value FROM o", lambda t: order_json(t).select("o_orderkey", F.explode(J.nested(F.col("j"), "$ref")).alias("x")).select("o_orderkey", "x.path", "x.value"))

# ---- text tests and hashes ---------------------------------------------------------------------------------------

query("text_absolute_uri", "SELECT page_id, regexp_matches(url, '^https?://[^/?#\\s]+[^\\s]*$') AS whole, false AS bare, page_id % 2 = 0 AS other FROM pages", lambda t: t.pages.select("page_id", X.is_absolute_uri(F.col("url")).alias("whole"), X.is_absolute_uri(F.regexp_replace("url", "^[a-z]+://", "//")).alias("bare"), X.is_absolute_uri(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("urn:x:"), "page_id")).otherwise(F.lit("http:///path"))).alias("other")))
query("text_rfc3339", "SELECT event_id, true AS utc, true AS shifted, false AS none, false AS no_day FROM events", lambda t: t.events.select("event_id", *[X.is_rfc3339(F.concat(F.date_format("ts", day), F.date_format("ts", "HH:mm:ss"), F.lit(end))).alias(n) for n, day, end in (("utc", "yyyy-MM-dd'T'", "Z"), ("shifted", "yyyy-MM-dd'T'", ".25+05:30"), ("none", "yyyy-MM-dd'T'", ""), ("no_day", "yyyy-MM-'32T'", "Z"))]))
query("text_pointers", "WITH p AS (SELECT a.p_size AS a, b.p_size AS b FROM (SELECT DISTINCT p_size FROM part) a, (SELECT DISTINCT p_size FROM part) b) SELECT a, b, a = b OR (b // 10 = a AND b > 9) OR (a // 10 = b AND a > 9) AS x FROM p", lambda t: t.part.select(F.col("p_size").alias("a")).distinct().crossJoin(t.part.select(F.col("p_size").alias("b")).distinct()).select("a", "b", X.pointers_overlap(*[F.when(F.col(c) > 9, F.concat(F.lit("/"), F.floor(F.col(c) / 10), F.lit("/"), F.col(c) % 10)).otherwise(F.concat(F.lit("/"), F.col(c))) for c in "ab"]).alias("x")))
query("text_types", "SELECT n_nationkey, len(list_intersect(CASE n_nationkey % 3 WHEN 0 THEN ['Row', 'Table'] WHEN 1 THEN ['Number'] ELSE ['ValueSet', 'Row'] END, CASE n_nationkey % 2 WHEN 0 THEN ['Row', 'Entity'] ELSE ['Number', 'Table'] END)) > 0 AS x FROM nation", lambda t: t.nation.select("n_nationkey", X.compatible_types(F.expr("case n_nationkey % 3 when 0 then 'Row | Table' when 1 then 'Number' else 'ValueSet|Row' end"), F.expr("if(n_nationkey % 2 = 0, 'Row|Entity', ' Number | Table ')")).alias("x")))
_CARD = "['one', 'optional', 'one_or_more', 'zero_or_more', 'some']"
query("text_cardinalities", f"WITH k AS (SELECT n_nationkey, {_CARD}[n_nationkey % 5 + 1] AS s, {_CARD}[n_nationkey // 5 + 1] AS e, CASE WHEN n_nationkey % 7 = 0 THEN 'RowSet' ELSE 'Row' END AS t FROM nation) SELECT n_nationkey, s <> 'some' AND e <> 'some' AND (e IN ('optional', 'zero_or_more') OR (e = 'one' AND (s = 'one' OR t = 'RowSet')) OR (e = 'one_or_more' AND (s IN ('one', 'one_or_more') OR t = 'RowSet'))) AS x FROM k", lambda t: t.nation.select("n_nationkey", X.compatible_cardinalities(*[F.get(F.array(*[F.lit(x) for x in ("one", "optional", "one_or_more", "zero_or_more", "some")]), i.cast("int")) for i in (F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5))], F.expr("if(n_nationkey % 7 = 0, 'RowSet', 'Row')")).alias("x")))
query("text_shown", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'N/A' ELSE printf('%.3f', l_quantity / 8) END AS x FROM lineitem", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", X.shown(F.when(F.col("l_linenumber") != 1, F.col("l_quantity") / 8)).alias("x")))
query("text_disposition", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 3 < 2 THEN 'ambiguous' ELSE 'partial' END WHEN p_size % 3 = 0 THEN 'resolved' WHEN p_size % 3 = 1 THEN 'ambiguous' ELSE 'partial' END AS x FROM part", lambda t: t.part.select("p_partkey", X.disposition(F.expr("case p_size % 3 when 0 then array('resolved', 'specified') when 1 then array('ambiguous', 'ambiguous') else array('ambiguous', 'abstained') end"), F.col("p_size") % 5 == 0).alias("x")))
query("text_key_variants", "WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Class-' WHEN 1 THEN 'Entr_ies' WHEN 2 THEN 'Ids' ELSE 'Note' END AS k FROM part) SELECT p_partkey, CASE k WHEN 'Class-' THEN 'class,clas' WHEN 'Entr_ies' THEN 'entries,entrie,entry' WHEN 'Ids' THEN 'ids,id' ELSE 'note' END AS x FROM k", lambda t: t.part.select("p_partkey", joined(X.key_variants(F.expr("case p_partkey % 4 when 0 then 'Class-' when 1 then 'Entr_ies' when 2 then 'Ids' else 'Note' end"))).alias("x")))
query("hash_ordered_ids", """SELECT o_custkey, sha256('["' || string_agg(o_orderkey::VARCHAR, '","' ORDER BY o_orderkey) || '"]') AS h FROM orders GROUP BY 1""", lambda t: t.orders.groupBy("o_custkey").agg(X.ordered_hash(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))).alias("h")))
query("hash_artifact_set", "SELECT n_regionkey, sha256(string_agg(sha256(n_name) || '  ' || n_name || chr(10), '' ORDER BY n_name)) AS h FROM nation GROUP BY 1", lambda t: t.nation.groupBy("n_regionkey").agg(X.ordered_lines_hash(F.collect_list(F.struct(F.col("n_name").alias("path"), F.sha2(F.col("n_name").cast("binary"), 256).alias("digest")))).alias("h")))
