import copy
import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import agreement as G
from tessera.operators import annotation as V
from tessera.operators import families as A
from tessera.operators import graphs as N
from tessera.operators import relational as R
from tessera.operators import sampling as L
from tessera.operators import views as W
from tessera.plans.check import check_plan
from tessera.plans.compile import PlanError, compile_plan
from tessera.plans.model import dump_plan, parse_plan
from tessera.queries import flagship_plan
from tessera.sources import records as S


def broken(change):
    p = copy.deepcopy(flagship_plan())
    change(p)
    return check_plan(p).codes()


def test_sound_plan():
    r = check_plan(flagship_plan())
    assert r.ok and r.order == ["n1", "n2", "n3", "n4", "n5", "n6"] and r.types["n5"] == "ValueSet"


@pytest.mark.parametrize(
    "code, change",
    [
        ("MISSING_FIELD", lambda p: p.pop("answer")),
        ("INVALID_FIELD_TYPE", lambda p: p.update(nodes={})),
        ("UNSUPPORTED_IR_VERSION", lambda p: p.update(ir_version="9")),
        ("EMPTY_NODES", lambda p: p.update(nodes=[])),
        ("DUPLICATE_NODE_ID", lambda p: p["nodes"][1].update(id="n1")),
        ("UNKNOWN_TYPE", lambda p: p["nodes"][0]["output"].update(type="Thing")),
        ("INVALID_REFERENCE", lambda p: p["nodes"][0]["inputs"].update(table="t")),
        ("INVALID_REFERENCE_KIND", lambda p: p["nodes"][0]["inputs"]["table"].update(kind="x")),
        ("DANGLING_SOURCE_REFERENCE", lambda p: p["nodes"][0]["inputs"]["table"].update(source_id="x")),
        ("DANGLING_NODE_REFERENCE", lambda p: p["nodes"][1]["inputs"]["rows"].update(node_id="x")),
        ("OUTPUT_PORT_MISMATCH", lambda p: p["nodes"][1]["inputs"]["rows"].update(port="x")),
        ("INVALID_ANSWER_REFERENCE", lambda p: p.update(answer={"kind": "source", "source_id": "t"})),
        ("ANSWER_TYPE_NOT_ELIGIBLE", lambda p: p["answer"].update(node_id="n1")),
        ("CYCLE_DETECTED", lambda p: p["nodes"][1]["inputs"]["rows"].update(node_id="n2")),
        ("UNKNOWN_OPERATOR", lambda p: p["nodes"][0].update(operator="SORT")),
        ("INPUT_ARITY_MISMATCH", lambda p: p["nodes"][1]["inputs"].update(table={"kind": "source", "source_id": "t"})),
        ("INPUT_SIGNATURE_MISMATCH", lambda p: p["nodes"][1].update(inputs={"entities": p["nodes"][1]["inputs"]["rows"]})),
        ("INPUT_TYPE_MISMATCH", lambda p: p["nodes"][3]["inputs"]["entities"].update(node_id="n2")),
        ("MISSING_ARGUMENT", lambda p: p["nodes"][4]["arguments"].pop("attribute")),
        ("UNKNOWN_ARGUMENT", lambda p: p["nodes"][4]["arguments"].update(span="x")),
        ("ARGUMENT_TYPE_MISMATCH", lambda p: p["nodes"][5]["arguments"].update(function="median")),
        ("OUTPUT_TYPE_MISMATCH", lambda p: p["nodes"][2]["output"].update(type="Entity")),
        ("TOOL_BINDING_MISMATCH", lambda p: p["nodes"][2].update(tool_binding="x")),
        ("INVALID_SCHEMA", lambda p: p["schema_ref"].update(columns=3)),
        ("INVALID_QUESTION_REF", lambda p: p["question_ref"].pop("question")),
        ("INVALID_SOURCE_LOCATOR", lambda p: p["sources"]["t"].update(locator={})),
        ("TABLE_ID_MISMATCH", lambda p: p["sources"]["t"]["locator"].update(table_id="x")),
        ("INVALID_COLUMN_REFERENCE", lambda p: p["nodes"][2]["arguments"].update(column="doc_id")),
        ("SCHEMA_COLUMN_INDEX_OUT_OF_RANGE", lambda p: p["nodes"][2]["arguments"].update(column={"index": 9, "label": "doc_id"})),
        ("SCHEMA_COLUMN_LABEL_MISMATCH", lambda p: p["nodes"][2]["arguments"].update(column={"index": 1, "label": "doc_id"})),
    ],
)
def test_codes(code, change):
    assert code in broken(change)


def test_not_object_and_dead_node():
    assert check_plan([]).codes() == ["GRAPH_NOT_OBJECT"]
    p = flagship_plan()
    p["answer"]["node_id"] = "n5"
    assert check_plan(p).warnings == [("DEAD_NODE", "n6", "")]


def test_predicate_values_are_not_coerced():
    def text_for_number(p):
        p["nodes"][0]["arguments"]["predicate"]["value"] = "1"

    assert "ARGUMENT_TYPE_MISMATCH" in broken(text_for_number)


def test_parse_plan():
    text = dump_plan(flagship_plan())
    assert parse_plan(f"```json\n{text}\n```").plan == flagship_plan()
    assert parse_plan('{"a":1,"a":2}').error and parse_plan('{"a":NaN}').error and parse_plan("[1]").error and parse_plan(text + text).error


def test_run_time_breaches(spark):
    t = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, v string")
    with pytest.raises(Exception, match="CARDINALITY_MISMATCH"):
        R.project(t, "k", cardinality="one").collect()
    with pytest.raises(Exception, match="TIE"):
        R.arg_extreme(t, R.to_number(F.col("v"))).collect()
    with pytest.raises(Exception, match="EMPTY_INPUT"):
        R.aggregate(t.where("false").select(F.col("v").alias("value")), "sum").collect()
    with pytest.raises(Exception, match="UNSUPPORTED_EXTRACTION"):
        R.extract(t.select(F.col("k").alias("text")), "mood", "Boolean").collect()
    with pytest.raises(Exception, match="DIVISION_BY_ZERO"):
        t.select(R.arithmetic(F.lit(1.0), F.lit(0.0), "divide")).collect()
    with pytest.raises(PlanError):
        compile_plan({}, {})
    assert R.filter_rows(t, "v", "eq", "1").count() == 2 and R.filter_rows(t, "v", "numeric_lt", 5).count() == 2


SEQUENCE = ["a", "b", "a", "c", "d", "a", "e", "b", "f", "g"]


def records(spark, sigs=SEQUENCE):
    return spark.createDataFrame([(i + 1, s, i % 2) for i, s in enumerate(sigs)], "position long, sig string, part int")


def test_families(spark):
    r = records(spark)
    s = A.summary(A.counts(r)).first()
    assert (s.records, s.families, s.singletons, s.doubletons, s.singleton_mass) == (10, 7, 5, 1, 0.5)
    assert {x.k: x.coverage for x in A.topk_coverage(A.counts(r)).collect()} == {1: 0.3, 5: 0.8, 10: 1.0, 20: 1.0}
    assert {x.s: x.expected for x in A.rarefaction(A.counts(r), 5).collect()} == {5: pytest.approx(4.194444, abs=1e-4), 10: 7.0}
    assert [(x.block, x.novel_records, x.new_families) for x in A.block_novelty(r, 5).orderBy("block").collect()] == [(1, 5, 4), (2, 3, 3)]
    assert [(x.position, x.families) for x in A.cumulative_curve(r, 5).orderBy("position").collect()] == [(5, 4), (10, 7)]
    assert A.transfer(r, 5).first()[:2] == (5, 2)


def test_positions_and_sequences(spark, sf):
    rows = A.event_sequences(spark.read.parquet(f"{sf}/events.parquet")).select("position").collect()
    assert sorted(x[0] for x in rows) == list(range(1, len(rows) + 1))
    e = spark.createDataFrame([(i, 1, t) for i, t in enumerate("aabba")], "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id"))
    assert A.event_sequences(e).select("fine", "contracted").first() == ("a>a>b>b>a", "a>b>a")


def test_graphs(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3), (2, 1, 2), (2, 2, 1)], "graph_id long, src long, dst long")
    reach = N.closure(e)
    one, two = e.where("graph_id = 1"), reach.where("graph_id = 1")
    assert sorted(tuple(x)[1:] for x in N.reduction(one, two).collect()) == [(1, 2), (2, 3)]
    assert {x.node: x.depth for x in N.depths(one).collect()} == {1: 1, 2: 2, 3: 3}
    assert sorted(tuple(x) for x in N.cyclic_components(reach).collect()) == [(2, 1, 1), (2, 1, 2)]
    with pytest.raises(RuntimeError):
        N.depths(e.where("graph_id = 2"), rounds=5)


def test_canonical_forms_are_complete():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 6)
        labels = {f"n{i}": rng.choice("ab") for i in range(n)}
        edges = {(f"n{i}", f"n{j}") for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}
        order = list(labels)
        rng.shuffle(order)
        to = dict(zip(labels, (f"x{order.index(k)}" for k in labels)))
        assert N.canonical(labels, edges) == N.canonical({to[k]: v for k, v in labels.items()}, {(to[a], to[b]) for a, b in edges})
    shapes = {N.canonical(dict.fromkeys("abc", "r"), set(e)) for k in range(4) for e in itertools.combinations([("a", "b"), ("b", "c"), ("a", "c")], k)}
    assert len(shapes) == 5  # none, one, fan out, fan in, chain (with or without its short cut)
    assert N.contract_runs({"a": "x", "b": "x", "c": "y"}, {("a", "b"), ("b", "c")}) == ({"a": "x", "c": "y"}, {("a", "c")})


def test_agreement(spark):
    a, b = (spark.createDataFrame([(1, x) for x in s], "g int, item string") for s in ("ab", "bc"))
    assert G.jaccard(a, b, ["g"], "item").first().jaccard == pytest.approx(1 / 3)
    assert G.dice(a, b, ["g"], "item").first().dice == 0.5
    p = G.purity(spark.createDataFrame([("s", 1), ("s", 1), ("s", 2), ("t", 2)], "sig string, p int"), "sig", "p").first()
    assert (p.purity, p.baseline, p.lift, p.singletons) == (0.75, 0.5, 0.5, 0.5)


def test_sampling(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("fam"), (F.col("id") % 4).alias("x"), (F.col("id") % 5).alias("y"))
    assert L.quota_pick(df, "fam", "id", "s").groupBy("fam").count().collect()[0]["count"] == 7
    picks = L.greedy_coverage(df, "fam", "id", ["x", "y"], "s").join(df, ["id", "fam"])
    assert picks.select("fam", "x").distinct().count() == 12 and picks.select("fam", "y").distinct().count() == 15
    proof = L.disjoint_proof(df, {"a": df.where("id < 50"), "b": df.where("id >= 50")}, "id").first()
    assert tuple(proof) == (100, 0, 0, 0)


def test_text_functions(spark):
    df = spark.createDataFrame([('{"a":{"b/c":[1,2]}}', "Cities", "2024-01-01T00:00:00Z")], "j string, k string, t string")
    r = df.select(X.json_pointer(F.col("j"), "/a/b~1c/1"), X.key_variants(F.col("k")), X.is_utc_timestamp(F.col("t")), X.strict_json(F.lit('{"a":1,"a":2}')).isNull()).first()
    assert r[0] == "2" and r[1] == ["cities", "citie", "city"] and r[2] and r[3]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"records": [{"a": 1}, {"a": 2}]}))
    assert sorted(r.a for r in S.read_json_documents(spark, str(tmp_path / "x.json"), "struct<a:int>").collect()) == [1, 2]
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n\n{"a": "no"}\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "y.jsonl"), "a int").collect()
    out = {str(tmp_path / "o1"): spark.range(3), str(tmp_path / "o2"): spark.range(4)}
    assert set(S.write_batch(out).values()) == {"written"}
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 4
    assert set(S.write_batch(out).values()) == {"unchanged"}
    with pytest.raises(FileExistsError):
        S.write_batch({str(tmp_path / "o1"): spark.range(9), str(tmp_path / "o3"): spark.range(1)})
    assert not (tmp_path / "o3").exists() and not (tmp_path / "o1.staged").exists()
    assert S.write_batch({str(tmp_path / "o1"): spark.range(9)}, overwrite=True) == {str(tmp_path / "o1"): "overwritten"}
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 9
    assert S.collisions(["/a/b"], ["/a/b/c", "/a/x"]) == ["/a/b/c"]


def test_streaming(spark, sf, tmp_path):
    from tessera.streaming.novelty import windowed_counts

    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_record_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n[1]\nno\r\n{"id": 1, "id": 2}\n')
    got = [(r.line_number, r.error) for r in S.numbered_lines(spark, str(tmp_path / "a.jsonl")).orderBy("line_number").collect()]
    assert got == [(1, None), (3, "not_an_object"), (4, "invalid_json"), (5, "invalid_json")]
    before = S.file_digests(spark, str(tmp_path / "*.jsonl")).collect()
    assert [(r.n_bytes, r.digest) for r in before] == [((tmp_path / "a.jsonl").stat().st_size, hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest())]
    a, b = (spark.createDataFrame(x, "path string, digest string") for x in ([("p", "1"), ("q", "2"), ("r", "3")], [("p", "1"), ("q", "9"), ("s", "4")]))
    assert sorted(tuple(r) for r in S.digest_differences(a, b).collect()) == [("q", "changed"), ("r", "gone"), ("s", "new")]
    parts = {n: spark.createDataFrame([(i, f"{n}{i}") for i in range(2)], "ordinal int, v string") for n in "xy"}
    routing = spark.createDataFrame([("x", 0, 3), ("x", 1, 1), ("y", 0, 2), ("y", 1, 4)], "part string, ordinal int, position int")
    assert [r.v for r in S.merge_parts(parts, routing).collect()] == ["x1", "y0", "x0", "y1"]
    for bad in (routing.where("position < 4"), routing.union(spark.createDataFrame([("z", 0, 5)], routing.schema))):
        with pytest.raises(Exception, match="UNROUTED"):
            S.merge_parts(parts, bad).collect()
    S.write_by_role(spark.createDataFrame([("a", 1), ("b", 2)], "dataset_role string, v int"), str(tmp_path / "roles"))
    assert sorted(x.name for x in (tmp_path / "roles").iterdir() if x.is_dir()) == ["dataset_role=a", "dataset_role=b"]
    S.write_once(spark.range(2), str(tmp_path / "once"))
    with pytest.raises(Exception, match="already exists"):
        S.write_once(spark.range(2), str(tmp_path / "once"))
    assert [r.value for r in S.canonical_lines(spark.createDataFrame([(2, "x"), (1, "y")], "b int, a string"), "b").collect()] == ['{"a":"y","b":1}', '{"a":"x","b":2}']
    j = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "j string")
    assert S.violations_of_json(j, "j").count() == 2


def test_walks_of_odd_json(spark):
    from tessera.functions import json_walk as J

    deep = "[" * 500 + '{"id": 7}' + "]" * 500
    texts = [None, "", "no", '{"a":1,"a":2}', "NaN", "3", deep, '{"question_ids":["x",5,true],"n":{"id":"hidden"},"Locked-Test":[{"qid":"z"}]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, j string")
    rows = df.select("i", J.key_paths(F.col("j")).alias("p"), J.explicit_ids(F.col("j")).alias("ids"), J.locked_ids(F.col("j")).alias("locked"), J.sanitized(F.col("j"), ["ids", "question_id"]).alias("s")).orderBy("i").collect()
    assert [r.p for r in rows[:6]] == [[]] * 6 and rows[5].s == "3" and rows[0].s is None and rows[3].s is None
    assert len(rows[6].p) == 1 and rows[6].p[0].endswith("].id")
    assert rows[7].ids == ["5", "x"] and rows[7].locked == ["z"] and rows[7].s == '{"n":{},"Locked-Test":[{"qid":"z"}]}'


def test_small_functions(spark):
    from tessera.operators import environment as E

    df = spark.createDataFrame([(" ", "b", "/a/b", "x~/y", "f" * 64, ["a", "b"])], "p string, q string, r string, s string, h string, l array<string>")
    r = df.select(
        X.first_non_blank(F.col("p"), F.col("q")), X.pointer_within(F.col("r"), F.lit("/a")), X.pointer_within(F.lit("/ab"), F.lit("/a")), X.pointer_escape(F.col("s")), X.is_digest(F.col("h")), X.shown(F.lit(None)),
        X.frequency_stratum(F.lit(99)), X.frequency_stratum(F.lit(100)), X.frequency_stratum(F.lit(0)), X.evidence_tier(F.lit(0)), X.ordered_hash(F.col("l")),
    ).first()
    assert list(r) == ["b", True, False, "x~0~1y", True, "N/A", "high_recurrent_20_99", "dominant_100_plus", None, None, hashlib.sha256(b'["a","b"]').hexdigest()]
    cells = spark.createDataFrame([("t", [[("a", ["d"]), ("b", [])], [("c", []), (None, [])]])], "table_id string, data array<array<struct<text:string,links:array<string>>>>")
    flat = E.from_nested(cells)
    assert flat.count() == 4 and E.to_wide(flat.withColumn("label", F.concat(F.lit("c"), "column_index")), ["c0", "c1"]).orderBy("row_index").collect() == [(0, "a", "b"), (1, "c", None)]
    assert [r.row_index for r in E.committed(spark.createDataFrame([("t", 5), ("t", 3)], "g string, v int"), "g", "v").orderBy("v").collect()] == [0, 1]
    R.register_reader("code", "[A-Z]{3}-[0-9]+")
    assert [r.value for r in R.extract(spark.createDataFrame([("see ABC-12",)], "text string"), "the code", "Code").collect()] == ["ABC-12"]


def test_new_signatures_stream(spark, tmp_path):
    from tessera.streaming.novelty import new_signatures

    spark.createDataFrame([("a",), ("b",), ("a",)], "sig string").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = new_signatures(spark.readStream.schema("sig string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("novel").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("novel").collect()) == [("a", 2), ("b", 1)]


def _least_form(labels, edges, marks):
    names, best = sorted(labels), None
    for order in itertools.permutations(names):
        at = {n: i for i, n in enumerate(order)}
        code = repr(([(labels[n], marks.get(n)) for n in order], sorted((at[a], at[b]) for a, b in edges)))
        best = code if best is None or code < best else best
    return best


def test_canonical_forms_by_brute_force():
    """Graphs of up to five nodes share a form exactly if some renaming makes them equal."""
    from tessera.operators import graphs as N

    rng = random.Random(3)
    forms: dict[str, str] = {}
    for _ in range(400):
        n = rng.randint(1, 5)
        labels = {f"n{i}": rng.choice("AB") for i in range(n)}
        edges = N.reduce_edges({(f"n{a}", f"n{b}") for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4})
        names = rng.sample(range(9), n)
        rename = {f"n{i}": f"x{names[i]}" for i in range(n)}
        for mine, arcs in ((labels, edges), ({rename[k]: v for k, v in labels.items()}, {(rename[a], rename[b]) for a, b in edges})):
            least = _least_form(mine, arcs, {})
            assert forms.setdefault(N.canonical(mine, arcs), least) == least
    assert len(set(forms.values())) == len(forms)


def test_canonical_forms_of_symmetric_graphs_end():
    from tessera.operators import graphs as N

    star = {"c": "A", **{f"l{i}": "B" for i in range(12)}}
    assert N.canonical(star, {("c", f"l{i}") for i in range(12)}) == N.canonical({**star, "c": "A"}, {("c", f"l{i}") for i in reversed(range(12))})
    assert json.loads(N.canonical({f"n{i}": "A" for i in range(10)}, set()))[1] == []
    code, names = N.semantic_quotient({"a": "R", "b": "R"}, {("a", "b")}, {"a"}, {"b"})
    assert names == {"a": "sq1", "b": "sq2"} or names == {"b": "sq1", "a": "sq2"}
    assert N.semantic_quotient({"x": "R", "y": "R"}, {("y", "x")}, {"y"}, {"x"})[0] == code != N.semantic_quotient({"a": "R", "b": "R"}, {("a", "b")}, {"a"}, {"a", "b"})[0]
    assert N.contract_runs({"a": "A", "b": "A", "c": "A", "d": "B"}, {("a", "b"), ("b", "c"), ("b", "d")}) == ({"a": "A", "c": "A", "d": "B"}, {("a", "c"), ("a", "d")})


def test_reduction_by_brute_force():
    from tessera.operators import graphs as N

    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(2, 7)
        edges = {(str(a), str(b)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        def reach(a, b, skip):
            return any(y == b or reach(y, b, skip) for x, y in edges if x == a and (x, y) != skip)
        assert N.reduce_edges(edges) == {e for e in edges if not reach(*e, e)}


def test_contracted_graphs(spark, sf):
    """Every graph of the catalogue's query by the function for one graph."""
    from tessera import queries as Q
    from tessera.operators import graphs as N

    t = Q.Tables(spark, sf)
    labels, edges = {}, {}
    for r in Q.labels_of(t).collect():
        labels.setdefault(r.graph_id, {})[str(r.node)] = r.label
    for r in Q.arcs(t).collect():
        edges.setdefault(r.graph_id, set()).add((str(r.src), str(r.dst)))
    for r in Q.QUERIES["g_contract_general"](spark, sf).collect():
        mine, arcs = N.contract_runs(labels[r.graph_id], edges[r.graph_id])
        assert (r.n_nodes, r.n_edges, r.labels) == (len(mine), len(arcs), ",".join(sorted(mine.values())))


def test_joins_that_check(spark):
    from tessera.operators import records as K

    a = spark.createDataFrame([(1, "x"), (2, "y")], "p int, i string")
    with pytest.raises(Exception, match="POSITION_MISMATCH"):
        K.positional_join(a, a.where("p = 1"), "p", "i").collect()
    with pytest.raises(Exception, match="POSITION_MISMATCH"):
        K.positional_join(a, a.withColumn("i", F.lit("x")), "p", "i").collect()
    with pytest.raises(Exception, match="DUPLICATE_RECORD"):
        K.first_present(spark.createDataFrame([("a", None), (None, "a")], "x string, y string"), ["x", "y"]).collect()


def test_first_expansion_triggers(spark):
    """Each trigger alone, and at its threshold, which is not enough."""
    from tessera.operators import decisions as D

    def decide(sigs, other=(), prefix=30):
        rows = [(i + 1, s, 1 + i % 5, i + 1 in other) for i, s in enumerate(sigs)]
        return D.first_expansion(spark.createDataFrame(rows, "position int, sig string, part int, other boolean"), prefix).first()

    calm = ["a", "b"] * 50
    assert decide(calm).decision == D.FREEZE and not decide(calm, range(1, 6)).other_rate
    assert decide(calm, range(1, 7)).other_rate and decide(calm, range(1, 7)).decision == D.EXPAND
    ten = [f"s{i}" for i in range(10)] + ["a", "b"] * 45
    assert not decide(ten).singleton_mass and decide([*ten[:-1], "z"]).singleton_mass
    two = [*calm[:40], "m", "m", "n", "n", *calm[:56]]
    assert decide(two).recurring and not decide([*calm[:40], "m", "m", *calm[:58]]).recurring
    last = [*calm[:80], *["m"] * 2, *calm[:8], *["n"] * 2, *calm[:8]]
    assert decide(last).last_blocks and not decide([*calm[:80], *["m"] * 2, *calm[:8], "n", *calm[:9]]).last_blocks


def test_strict_plans(spark):
    rows = spark.createDataFrame([("Aa", 1), ("b", 2), ("b ", 3)], "k string, v int")
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert [r.v for r in R.join_once(rows, "k", keys("aa"), "normalized").collect()] == [1]
    assert R.join_once(rows, "k", keys()).count() == 0
    for wrong, code in (("b", "AMBIGUOUS_MATCH"), ("c", "NO_MATCH"), (None, "NO_MATCH")):
        with pytest.raises(Exception, match=code):
            R.join_once(rows, "k", keys("aa", wrong), "normalized").collect()
    docs = spark.createDataFrame([("x", "one"), ("y", None)], "document_id string, text string")
    assert {tuple(r) for r in R.retrieve_all(keys("x", "y"), docs).collect()} == {("x", "one"), ("y", None)}
    for wrong, code in (("z", "MISSING_DOCUMENT: z"), (None, "MISSING_LINK")):
        with pytest.raises(Exception, match=code):
            R.retrieve_all(keys("x", wrong), docs).collect()


def test_selection_by_key(spark):
    v = spark.createDataFrame([("a", "1"), ("b", "5"), ("c", "5"), ("b", "5")], "key string, value string")
    assert {r.value for r in R.select_keys(v, "max", "Number", "all").collect()} == {"b", "c"}
    assert R.select_keys(v, "min", "Number", "error").first().value == "a"
    for rows, code in ((v, "TIE"), (v.where("false"), "EMPTY_INPUT"), (v.selectExpr("key", "'x' AS value"), "PARSE_FAILURE")):
        with pytest.raises(Exception, match=code):
            R.select_keys(rows, "max", "Number", "error").collect()
    from tessera.queries_annotation import selection_plan

    assert check_plan(selection_plan("all")).ok and check_plan(selection_plan("error")).ok

    def changed(**arguments):
        p = selection_plan("all")
        p["nodes"][4]["arguments"].update(arguments)
        return check_plan(p).codes()

    assert changed(relation="gt") == changed(**{"return": "boolean"}) == ["ARGUMENT_TYPE_MISMATCH"]
    assert changed(tie_policy="error") == ["OUTPUT_TYPE_MISMATCH"]
    p = selection_plan("all")
    del p["nodes"][4]["arguments"]["parse"]
    assert check_plan(p).codes() == ["ARGUMENT_ARITY_MISMATCH"]


def test_views(spark):
    df = spark.createDataFrame([(1, [("q", "a")], {"k": ("w",)}), (2, None, None)], "id long, turns array<struct<text: string, Answer_Text: string>>, notes map<string, struct<why: string>>")
    assert W.field_paths(df.schema) == ["$.id", "$.turns", "$.turns[*].text", "$.turns[*].Answer_Text", "$.notes", "$.notes.*.why"]
    assert W.free_text(df, ["answer text", "WHY"]) == ["$.turns[*].Answer_Text", "$.notes.*.why"]
    assert W.exact_view(df.select("id", F.lit(1).alias("x")), ["id", "y"]) == ["extra: $.x", "missing: $.y"]
    with pytest.raises(Exception):
        W.allowed(df, ["id", "gone"])
    assert [tuple(r) for r in W.steps_to_edges(df.selectExpr("'p' AS p", "id"), ["p"], "id", "id").orderBy("id").collect()] == [("p", 1, None), ("p", 2, 1)]
    route = spark.createDataFrame([(1, "A")], "id long, partition string")
    with pytest.raises(Exception, match="UNROUTED: 2"):
        W.packets(df, route, "id", ["id"]).collect()
    cells = spark.createDataFrame([("a|b\nc", 0.5), (None, None)], "t string, x double")
    assert [r.value for r in W.markdown(cells, [F.col("t").desc()]).orderBy("position").collect()] == ["| t | x |", "| --- | --- |", r"| a\|b c | 0.500 |", "| N/A | N/A |"]
    none = spark.createDataFrame([(1, None, None)], "id long, n int, s boolean")
    assert {r.message for r in W.attempts(none, "id", "n", "s").collect()} == {"not numbered 1 to n", "last attempt only is submitted"}


def test_annotation_rules_on_nulls_and_empty_tables(spark):
    ids = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "a")], "r long, id string")
    found = lambda v: sorted((r.key, r.message) for r in v.collect())
    assert found(V.repeated(ids, ["r"], "id", "x")) == [("1:a", "repeated"), ("1:null", "missing")]
    assert found(V.unresolved(ids, ["r"], "id", ids.where("false"), "id", "x")) == [("1:a", "unknown"), ("null:a", "unknown")]
    assert found(V.outside(ids, ["r"], "id", ["a"], "x")) == [("1", "missing")]
    assert found(V.binding_kinds(ids.selectExpr("r", "id", "CAST(NULL AS STRING) AS k"), ["r"], "id", "k")) == [("1", ""), ("1", "a"), ("1", "a"), ("null", "a")]
    reviews = spark.createDataFrame([(1, "adjudicated", None, 2, None, "adjudicated"), (2, None, False, None, False, None)], "id long, state string, gold_claimed boolean, human_review_count long, has_adjudication boolean, bundle_status string")
    people = spark.createDataFrame([(1, "x"), (1, "y")], "id long, reviewer_id string")
    assert found(V.review_states(reviews, people, "id")) == [("1", "adjudication_missing"), ("2", "count_disagrees")]
    ports = spark.createDataFrame([], "g long, node long, port string, source_node long, source_port string, type string, cardinality string")
    assert V.wiring(ports, ports, ports.withColumn("depends_on", F.col("node")), ["g"]).count() == 0


def test_family_picks_against_brute_force(spark):
    families, names = [None, "a", "b"], ["x", "y", "z", None]
    rows = [(i, families[(i * i) % 3], names[i % 4], names[(i * 7) % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, fam string, f string, g string")
    rank = lambda r: hashlib.sha256(f"s\0{r[1] or ''}\0{r[0]}".encode()).hexdigest()
    by_hash, covering = set(), set()
    for fam in {r[1] for r in rows}:
        left = sorted((r for r in rows if r[1] == fam), key=rank)
        k = min(len(left), 1 + (len(left) - 1).bit_length())
        by_hash |= {(fam, r[0], i + 1) for i, r in enumerate(left[:k])}
        seen = set()
        for i in range(k):
            gain = [len({(c, r[c]) for c in (2, 3) if r[c] is not None} - seen) for r in left]
            r = left.pop(gain.index(max(gain)))
            seen |= {(c, r[c]) for c in (2, 3) if r[c] is not None}
            covering.add((fam, r[0], i + 1))
    assert {tuple(r) for r in L.quota_pick(df, "fam", "id", "s").select("fam", "id", "pick").collect()} == by_hash
    assert {tuple(r) for r in L.greedy_coverage(df, "fam", "id", ["f", "g"], "s").collect()} == covering
    plan = L.quota_pick(df, "fam", "id", "s")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
