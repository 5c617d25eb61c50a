"""Each operator on hard rows, against brute force where SQL cannot say what is right."""

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from tessera.llm import arrays as A
from tessera.llm import decontaminate, html_extract, mixing, ngram_join, quality, queries, secrets, token_blocks, toxicity, url_vocab, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977} Éa{i % 31}" for i in range(60_000))
BASE = " ".join(f"base{i}" for i in range(300))
TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "two words", "Ünï cödé\u00a0nbsp\u2028line \u65e5\u672c\u8a9e", "a a a a a a a a a a a a", LONG, LONG + " more", BASE, BASE.upper(), BASE + " extra words",
    BASE.replace("base7 ", "other "), "same line\nsame line\n\n \nsame line\n", "x " * 9, "x y z " * 40, "token = \"abcdef123456\" token: key password='p@ss' secret=12345 SECRET:=  abcdefgh",
    "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 30 + " AKIA1234 " + "f" * 24 + " " + "0" * 23, "user: alice https://db.example.org/x?y=1 password = hunter2hunter2 Ab1" + "Cd2" * 12, "<|endoftext|> it's we'll 123 !!! 'tis",
    "you idiot moron", "\ud83d\ude00 emoji \U0001f600",
]
TEXTS = [t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t for t in TEXTS]
CLASH = "n_words long, key long, row long, hash long, id long, sid long, n long, term long, weight long, kept long, p long, text_ long, component_id long, score long, label long, bits long, _p long, _u long, topic long, u long, pos long"


def docs_of(spark, texts, ids=None):
    n = len(CLASH.split(","))
    rows = [((i if ids is None else ids[i]), t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src0", len(t or ""), *[7] * n) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in all columns, empty and long texts, copies, one row twice, clashing columns."""
    df = docs_of(spark, TEXTS)
    return df.union(df.where("doc_id = 9")).union(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i in (20,))) for i in range(22)] + [(None, 1, 1), (3, None, None), (999, 1, 1), (9, 0, 0)]
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, quality int, toxic int, text long")


ITEMS = "item_id long, text string, doc_id long"


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], ITEMS)


OPERATORS = {
    "quality": lambda s, d, l: quality.judge(d, l),
    "quality_kept": lambda s, d, l: quality.kept_documents(d, l),
    "mixing": lambda s, d, l: mixing.sample(d)[0],
    "decontaminate": lambda s, d, l: decontaminate.leaks(d, bench(s, [(0, BASE), (1, None), (None, "x"), (2, "")])),
    "clean": lambda s, d, l: decontaminate.clean_documents(d, bench(s, [(0, BASE)])),
    "join": lambda s, d, l: ngram_join.ngram_components(d, 3, 9, 10),
    "one_of_each": lambda s, d, l: ngram_join.one_of_each(d),
    "tokens": lambda s, d, l: token_blocks.token_digest(d),
    "secrets": lambda s, d, l: secrets.find_secrets(d),
    "toxicity": lambda s, d, l: toxicity.toxicity(d, l),
}
PER_ROW = {"quality", "mixing", "join", "tokens", "secrets", "toxicity"}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, hard, labels, name):
    rows = OPERATORS[name](spark, hard, labels).collect()
    if name in PER_ROW:
        assert len(rows) == hard.count()
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in rows) if "doc_id" in rows[0] else []
    if name == "quality_kept":  # long enough and not repetitive
        assert ids == sorted(i for i, x in enumerate(map(counts_of, TEXTS)) if x[0] >= 10 and 100 * x[4] <= 20 * x[0] for _ in range(2 if i == 9 else 1))
    if name == "decontaminate":  # BASE, in other case, with words more, with one changed; doc 9 once
        assert [i for i, r in zip(ids, sorted(rows, key=lambda r: r.doc_id)) if r.contaminated] == [9, 10, 11, 12]
    if name == "clean":
        assert ids == sorted({*range(len(TEXTS)), -1} - {9, 10, 11, 12})
    if name == "one_of_each":  # LONG and its copy, BASE and its copies, the last x y z; the row without id stays
        label = [c for _, c in components(TEXTS, 5, 4, 5)]
        assert ids == sorted({*label, -1})


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, hard, labels, name):
    assert OPERATORS[name](spark, hard.limit(0), labels).count() == 0
    if name in PER_ROW:
        assert OPERATORS[name](spark, hard, labels.limit(0)).count() == hard.count()


def counts_of(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {}
    for x in windows:
        many[x] = many.get(x, 0) + 1
    covered = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(hard):
    for r in quality.text_statistics(hard).where("doc_id is not null").collect():
        assert tuple(r)[1:6] == counts_of(TEXTS[r.doc_id]), r.doc_id


def test_quality_counts_of_all_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = quality.op1_query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        c = counts_of(texts[r.doc_id])
        assert tuple(r)[1:6] == c and r.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0]) and (r.kept is False or not r.base_failed)


def test_quality_held_out(spark, sf):
    """Learned from two thirds of the labels, judged on the rest."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels.where(~fold)).join(labels.where(fold), "doc_id").collect()
    good, bad = ([r.kept for r in got if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.25 * len(bad)
    for r in got:
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_decision_list():
    rng = np.random.default_rng(1)
    x = rng.random((900, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)
    rules = quality.learn_list(x, bad, ["a", "b", "c"])
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= quality._covers(x, [("abc".index(f), a, v) for f, a, v in r.tests])
    assert (hit == bad).mean() > 0.97 and (hit & ~bad).sum() <= 10
    assert quality.learn_list(x, np.zeros(900, bool), ["a", "b", "c"]) == []


def shingles(text, k):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def components(texts, k, num, den):
    sets, label = [shingles(t, k) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(len(s), c) for s, c in zip(sets, label)]


def test_join_on_hard_rows(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(spark, TEXTS), 3, 9, 10).collect()}
    assert [got[i] for i in range(len(TEXTS))] == components(TEXTS, 3, 9, 10)


@pytest.mark.parametrize("k, num, den, leaf", [(3, 9, 10, 512), (5, 4, 5, 512), (2, 1, 2, 3)])
def test_join_against_all_pairs(spark, k, num, den, leaf):
    rng = np.random.default_rng(k)
    texts = []
    for size in (3, 12, 60, 800, 1700):
        for _ in range(3):
            base = [f"v{x}" for x in rng.integers(0, 5000, size)]
            texts.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for at in rng.integers(0, size, max(1, int(size * rng.choice([0.01, 0.02, 0.05])))):
                    copy[at] = f"u{rng.integers(0, 9999)}"
                texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(spark, texts), k, num, den, leaf).collect()}
    want = components(texts, k, num, den)
    assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(texts)


def test_join_at_a_third(spark):
    """Sets of up to three times the other's size, so that classes of several sizes lie between."""
    rng = np.random.default_rng(9)
    texts = []
    for size in (700, 1390, 2500):
        base = [f"v{x}" for x in rng.integers(0, 90_000, size)]
        texts += [" ".join(base), " ".join(base + [f"u{x}" for x in rng.integers(0, 90_000, int(size * 0.99))]), " ".join(base + [f"t{x}" for x in rng.integers(0, 90_000, int(size * 1.9))])]
    for num, den in ((1, 3), (2, 5), (1, 2)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(spark, texts), 3, num, den).collect()}
        want = components(texts, 3, num, den)
        assert [got[i] for i in range(len(texts))] == want and len({c for _, c in want}) < len(texts)


def test_join_of_frequent_shingles_and_large_groups(spark, monkeypatch):
    """Hot shingles, buckets beyond a task, groups of many leaves, nodes above the leaves: the same components."""
    for name, value in (("BUCKET", 6), ("HOT", 1), ("FAN", 2), ("LEAF_SHINGLES", 400)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(4)
    texts = []
    for size in (30, 60):
        base = [f"v{x}" for x in rng.integers(0, 5000, size)]
        for n in range(40):
            copy = list(base)
            for at in rng.choice(size, n % 4, replace=False):
                copy[at] = f"u{rng.integers(0, 9999)}"
            texts.append(" ".join(copy))
    texts += texts[:20] + [f"{texts[0]} {texts[40]} w{i}" for i in range(9)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(spark, texts), 3, 7, 10, 4).collect()}
    want = components(texts, 3, 7, 10)
    assert [got[i] for i in range(len(texts))] == want and 2 < len({c for _, c in want}) < len(texts)


@pytest.mark.parametrize("num, den", [(9, 10), (4, 5), (1, 2)])
def test_buckets_keep_all_that_may_link(spark, num, den):
    """Of a bucket stay all rows with a partner by sizes and places, and none without one of a size that may do, copies or not."""
    rng = np.random.default_rng(num)
    rows = []
    for key in range(300):
        for sid in range(int(rng.integers(1, 6))):
            n = int(rng.integers(1, 60))
            at = int(rng.integers(0, n - (num * n + den - 1) // den + 1))
            rows += [(key * 10 + sid, 1, n, at, key, int(key % 50 == 0))] * int(rng.integers(1, 3))

    def may(a, b):
        common = min(a[2] - a[3], b[2] - b[3])  # if this is their rarest common shingle
        return a[0] != b[0] and a[4] == b[4] and common * (num + den) >= num * (a[2] + b[2])

    frame = spark.createDataFrame(rows, "sid long, part int, n int, at int, key long, salt int")
    got = {(r.sid, r.part, r.key, r.salt) for r in ngram_join._with_company(frame, num, den).collect()}
    want = {(a[0], a[1], a[4], a[5]) for a in rows if a[5] or any(may(a, b) for b in rows)}
    assert want <= got < {(a[0], a[1], a[4], a[5]) for a in rows}
    alike = {(a[0], a[1], a[4], a[5]) for a in rows if a[5] or any(a[0] != b[0] and a[4] == b[4] and num * max(a[2], b[2]) <= den * min(a[2], b[2]) for b in rows)}
    assert got <= alike


def test_bitmaps_are_sent_only_where_sizes_allow(spark, monkeypatch):
    """Texts that hold one another, of twice the size: nothing left to compare; near copies are."""
    seen = {}

    def written(df, name, write=ngram_join.written):
        out = write(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    texts = [" ".join(f"u{i}x{j}" for j in range(n)) for i in range(3) for n in (200, 400)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs_of(spark, texts), 3, 9, 10).collect()}
    assert got == {i: i for i in range(6)} and seen["members"] == 0
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs_of(spark, [*texts, texts[3] + " end"]), 3, 9, 10).collect()}
    assert got == {i: i for i in range(6)} | {6: 3} and seen["members"] == 2


def test_one_of_each_by_row(spark):
    """Repeated doc_ids of different texts: only rows with a copy go."""
    a, b = "a b c d e f g h", "z y x w v u t s"
    out = ngram_join.one_of_each(docs_of(spark, [a, a, b, a + " i", b], [1, 5, 5, 1, None]))
    rows = sorted(((r.doc_id or -1), r.text) for r in out.collect())
    assert len(rows) == 3 and rows[0] == (-1, b) and rows[2] == (5, b) and rows[1][0] == 1


def test_signature_tree_prunes_no_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
        sets += [np.unique(np.where(rng.random(200) < 0.03, rng.integers(0, 1 << 62, 200, dtype=np.uint64), base)) for _ in range(9)]
    sizes, bits = np.array([len(s) for s in sets]), ngram_join.signatures(sets)
    links = ngram_join.spanning_links(sizes, bits, None, 4, 5, lambda x, y: ngram_join.linked(sets[x], sets[y], 4, 5))
    cut = ngram_join.spanning_links(sizes, bits, 50, 4, 5, lambda x, y: ngram_join.linked(sets[x], sets[y], 4, 5))
    def groups(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        return label

    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert groups(links) == groups(every)
    assert groups(cut) == groups([(i, j) for i, j in every if i >= 50 > j])


def test_one_of_each(spark):
    df = docs_of(spark, ["a b c d e f", "a b c d e f", "", "", None, "z y x w v u"], [5, 2, 3, 4, 6, 7])
    out = ngram_join.one_of_each(df.union(df.where("doc_id = 7")))
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 6, 7]


QUESTION = "A train leaves London at 5 km per hour and meets Alice after 12 hours of travel through green hills and quiet valleys, how far did it go"


def test_decontamination_of_templates(spark):
    same_ = QUESTION.replace("5 km", "70 miles").replace("12 hours", "9 days").replace("Alice", "Robert").replace("London", "Paris")
    texts = [f"Intro words here. {QUESTION} and more.", f"Other start. {same_}", QUESTION.lower(), QUESTION.upper(), "A train leaves London", same_.replace(" 9 ", " 70 "), None, "", QUESTION.title().replace("12", "13")]
    rows = {r.doc_id: r for r in decontaminate.leaks(docs_of(spark, texts), bench(spark, [(1, QUESTION), (2, "short one"), (3, "5 words are quite enough")])).collect()}
    assert rows[0].contaminated and rows[0].exact and rows[1].contaminated and not rows[1].exact
    assert not rows[5].contaminated  # 5 and 12 both became 70
    assert all(rows[i].contaminated for i in (2, 3, 8))  # in other case
    assert not {4, 6, 7} & set(rows)


PASSAGE = (
    "the old bridge was built in 1912 by a small crew of masons from the valley who cut the stone by hand and since 1912 it has carried"
    " the road over the river without any repair at all"
)


def test_decontamination_with_one_altered_value(spark):
    """A verbatim passage in which one of two equal numbers was altered, as it is and with all other values replaced too."""
    texts = [f"intro {PASSAGE[::-1].replace('1912'[::-1], '1921'[::-1], 1)[::-1]} end", "nothing of the sort is told here in 1912 by anyone at all"]
    other = "every box holds 5 red pens and 5 blue pens so 40 boxes hold some pens and 5 more are lost on the way to the shop in the old town"
    texts += [other.replace("40", "60").replace(" 5 ", " 7 ").replace("7 more", "8 more")]
    rows = {r.doc_id: r for r in decontaminate.leaks(docs_of(spark, texts), bench(spark, [(1, PASSAGE), (2, other)])).collect()}
    assert set(rows) == {0, 2}
    assert rows[0].n_matched == rows[0].n_windows and rows[0].contaminated and not rows[0].consistent and not rows[0].exact
    assert rows[2].contaminated and not rows[2].consistent and rows[2].n_agreed < rows[2].n_matched


STORY = "James buys 5 apples and 3 pears at the market. James eats 2 apples on the way home. How many apples and pears does James have left?"
TRAVEL = (
    "a group of 12 students left the station early in the morning to visit Paris with their teacher and they paid 40 euros"
    " for every ticket so how much money did the whole group of students spend"
)


def test_decontamination_of_names_and_shifted_words(spark):
    """Names that begin sentences, names of other lengths and words put in or left out."""
    items = bench(spark, [(1, STORY), (2, TRAVEL)])
    texts = [
        STORY.replace("James", "Maria"), STORY.replace("James", "Mary Ann").replace("5", "9"), "Problem: \"" + STORY.replace("James", "Maria") + "\"", TRAVEL.replace("Paris", "New York"),
        TRAVEL.replace("with their", "together with their"), TRAVEL.replace("with their teacher", "with teacher").replace("12", "15"), TRAVEL.replace("Paris", "the small town"),
        "Maria has 5 dogs. James likes 3 of them. Paris is far away.", STORY[:40] + " and nothing else", " ".join(reversed(TRAVEL.split())),
    ]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, texts), items).where("contaminated").collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2)}


def test_decontamination_counts_repeats_once(spark):
    """A short run of numbers is not the long list of numbers that it would match at many shifts, nor are sentences of one word others."""
    items = bench(spark, [(1, " ".join(str(i) for i in range(100, 130))), (2, "Dog. Cat. Bird. Fish. Cow. Horse.")])
    texts = [" ".join(str(i) for i in range(200, 211)), "Red. Green. Blue. White. Black. Brown."]
    assert not decontaminate.leaks(docs_of(spark, texts), items).where("contaminated").count()


def test_decontamination_finds_contained_items(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op4_query(spark, sf).collect()}
    assert want and got == want


def test_clean_documents_by_row(spark):
    """Rows with one doc_id are judged by their own text; rows without doc_id too."""
    docs = docs_of(spark, [QUESTION, "quite another text", QUESTION, "a b c"], [1, 1, None, None])
    out = decontaminate.clean_documents(docs.union(docs), bench(spark, [(1, QUESTION)]))
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == ["a b c"] * 2 + ["quite another text"] * 2


def test_decontamination_of_number_tables(spark):
    """Windows of numbers alone match by value: a table is found whole, others of its shape are not, and do not meet it in the join."""
    table = " ".join(str(i * 7 % 1000) for i in range(100))
    texts = [f"see {table} there", " ".join(str(i * 11 % 997) for i in range(2000)), table.replace("7", "8")]
    rows = {r.doc_id: r for r in decontaminate.leaks(docs_of(spark, texts), bench(spark, [(1, table)])).collect()}
    assert set(rows) == {0} and rows[0].contaminated and rows[0].exact


def test_raking_meets_targets(spark, sf):
    drawn, cells = mixing.sample(spark.read.parquet(f"{sf}/documents.parquet"), rounds=40)
    assert mixing.margin_error(cells) < 1e-6
    total, expected = drawn.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability"))).first()
    assert expected == pytest.approx(mixing.BUDGET * total, rel=1e-9)


def test_raking_goes_on_while_the_error_falls(spark, caplog):
    cells = [("a", "x", "t", 1, 1000), ("a", "y", "t", 1, 1), ("b", "x", "t", 1, 1), ("b", "y", "t", 1, 1000)]
    cells = spark.createDataFrame(cells, "source string, lang string, topic string, n_docs int, tokens long")
    goal = {m: spark.createDataFrame([(k, x) for k, x in zip(keys, (0.7, 0.3) if m == "source" else (0.5, 0.5))], f"{m} string, share double") for m, keys in (("source", "ab"), ("lang", "xy"))}
    assert mixing.margin_error(mixing.rake(cells, targets=goal, rounds=1)) <= mixing.TOLERANCE and not caplog.records


def test_mixing_with_given_targets(spark):
    cells = spark.createDataFrame([("a", "x", "t", 1, 90), ("b", "x", "t", 1, 10), (None, "x", "t", 1, 0)], "source string, lang string, topic string, n_docs int, tokens long")
    goal = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 1.0)], "source string, share double")
    out = {r.source: r for r in mixing.probabilities(mixing.rake(cells, targets={"source": goal}), 0.19).collect()}
    assert out["a"].weight == pytest.approx(0.5) and out["b"].weight == pytest.approx(0.5) and out[None].weight == 0
    assert out["a"].p == pytest.approx(9.5 / 90) and out["b"].p == pytest.approx(0.95)
    assert sum(r.tokens * r.p for r in out.values()) == pytest.approx(19)


def test_html_pages(spark, sf):
    for r in html_extract.op3_query(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b&nbsp;c", "a\nb c"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<p>x<p class=\"y", "x"),
        ("<script>if (a<b) '</p>'</script><p>t</p><style>p{}</style>", "t"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<header>H</header><nav>N</nav><article><header><h1>T</h1></header><p>One, two.</p><footer>F</footer></article><aside>A</aside><div class='cookie-notice'>C</div>", "T\nOne, two."),
        ("<main><p>Text that is long, and has marks.</p><div id=comments><article class=comment><p>Nice!</p></article></div><form><p>Mail?</p></form></main>", "Text that is long, and has marks."),
        ("<body><div id=menu>m</div><div class=post><h2>Head</h2><p>A long paragraph, with commas, and more.</p><p>Short</p></div><div class='ad banner'>Buy</div><div role=contentinfo>c</div></body>", "Head\nA long paragraph, with commas, and more.\nShort"),
    ],
)
def test_html_cases(page, want):
    assert html_extract.main_text(page) == want


PROSE = "".join(f"<p>Sentence {i} is long, has marks, and tells something.</p>" for i in range(4))
SAID = "\n".join(f"Sentence {i} is long, has marks, and tells something." for i in range(4))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><h1>T</h1>{PROSE}<ul class=x><li><a href=a>One more</a><li><a href=b>Another</a></ul></article>", f"T\n{SAID}"),
        (f"<div class='layout-with-sidebar'><article><h1>T</h1>{PROSE}</article></div>", f"T\n{SAID}"), (f"<article class='post related'>{PROSE}</article>", SAID),
        (f"<div class=has-sidebar><article>{PROSE}</article><div class=sidebar><p>Text of it.</p></div></div>", SAID), (f"<article>{PROSE}</article><div class=sidebar><article>Other, text.</article></div>", SAID),
    ],
)
def test_html_scores_decide(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class='content has-sidebar'><article>{PROSE}</article></div>", SAID), (f"<article>{PROSE}<div class=discussion>{PROSE}</div></article>", f"{SAID}\n{SAID}"),
        (f"<article>{PROSE}<section class='related-work'>{PROSE}</section></article>", f"{SAID}\n{SAID}"), (f"<body><div>{PROSE}<p>See <a href=x>this page of many words</a>.</p>{PROSE}</div></body>", f"{SAID}\nSee this page of many words.\n{SAID}"),
        (f"<article><p title=don't>first, one.</p>{PROSE}</article>", f"first, one.\n{SAID}"), (f"<div class=box>Buy</div><div class=text>{PROSE}</div><div class=links><a href=a>Home</a> <a href=b>More of it</a></div>", SAID),
        (f"<article>{PROSE}<div class=comments>{PROSE * 9}</div></article>", SAID), (f"<div class=ad>Buy, buy, and buy again.</div><article><h1>A</h1></article>", "A"), ("<div class=ad>Buy, buy.</div><article><p> </p></article>", ""),
        (f"<main><article>{PROSE}</article><article>{PROSE}</article></main>", f"{SAID}\n{SAID}"), ("<div class=ad>Only this.</div>", "Only this."),
    ],
)
def test_html_content_nodes(page, want):
    assert html_extract.main_text(page) == want


def test_html_paths_choose_without_articles(spark, sf, monkeypatch):
    """The pages with div for article, and with neutral classes around: blocks right and found; equal scores give other texts."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()
    for change in (lambda h: h.replace("article>", "div>"), lambda h: h.replace("article>", "section>").replace('class="ad"', 'class="x"')):
        hit = n_want = n_got = 0
        for r in rows:
            want, got = html_extract.main_text(r.html).split("\n"), html_extract.main_text(change(r.html)).split("\n")
            hit, n_want, n_got = hit + len(set(want) & set(got)), n_want + len(set(want)), n_got + len(set(got))
        assert hit >= 0.95 * n_want and hit >= 0.85 * n_got
    right = [html_extract.main_text(r.html) for r in rows]
    monkeypatch.setattr(html_extract, "path_scores", lambda blocks: ([1.0] * len(blocks), 0.5))
    assert sum(html_extract.main_text(r.html) != w for r, w in zip(rows, right)) > 0.9 * len(rows)


def test_html_time_and_depth():
    import time

    for page in ("<div>" * 20_000 + "</p>" * 20_000 + "deep", "<li>" * 20_000 + "x", "<ul><li><div>" * 8_000 + "x", "<p a='" * 5_000):
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 5


@pytest.mark.parametrize("tag", ["<svg/>", "<svg class=x />", "<math/>", "<video src=x>", "<object data=x>", "<svg><text>no</text></svg>", "<select><option>no</select>"])
def test_html_elements_without_end(tag):
    assert html_extract.main_text(f"<article><div>{PROSE}{tag}</div>{PROSE}</article>") == f"{SAID}\n{SAID}"
    if "/>" in tag or "</" in tag:
        assert html_extract.main_text(f"<article><p>a, b. {tag} c, d.</p></article>") == "a, b. c, d."


def test_html_extra_columns_and_empty(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>t</p>", "x"), (1, "u", "<div>" * 5000 + "deep", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()) == [("", 0), ("deep", 4), ("t", 1)]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_url_cases(spark):
    urls = {
        "http://WWW.Example.ORG/es/1": ("org/", "x"), "https://example.org/es/1?x": ("example.org/es/", "block"), "https://a.example.org/en/12": ("example.org/en/1", "block"), "https://a.example.org/en/2": ("org/", "allow"),
        "http://x.com/de/1": ("com/de/", "block"), "http://x.com/fr/casino": ("com/fr/", "allow"), "http://best-casino.net/": (None, "block"), "http://mycasinos.net/x": (None, "allow"), "http://free-bets.net/": (None, "block"),
        "http://free.net/free": (None, "allow"), "nothing": (None, "allow"), "http://org": (None, "allow"), "http://xorg/": (None, "allow"), None: (None, "allow"), "a://b://c/?d": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_vocab.judge_urls(pages).collect()}
    for i, (u, (rule, verdict)) in enumerate(urls.items()):
        if verdict != "x":
            assert (got[i].rule, got[i].verdict) == (rule, verdict), u
    assert (got[0].host, got[0].path, got[0].rule) == ("www.example.org", "/es/1", "example.org/es/") and (got[14].host, got[14].path) == ("b:", "//c/")
    assert url_vocab.judge_urls(pages.limit(0)).count() == 0


def test_url_vocabulary(spark):
    """Terms of a table against brute force: boundaries, escapes, weights, repeated and empty terms."""
    table = [("casino", "strict", 1.0), ("CASINO", "soft", 9.0), ("win", "soft", 0.5), ("big win", "soft", 1.0), ("x", "soft", 3.0), ("", "strict", 1.0), (None, "soft", 1.0), ("über", "soft", None)]
    urls = ["http://a/casino", "http://a/%63asino%2Fwin", "http://a/%20casino", "http://a/casinos", "http://a/win?x", "http://a/big%20win", "http://a/x/x/x", "http://a/win-win-big win", "http://a/über/x", "http://a/%zz%C3casino", "", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    words = {"casino": ("strict", 1.0), "win": ("soft", 0.5), "big win": ("soft", 1.0), "x": ("soft", 3.0), "über": ("soft", 0.0)}
    for vocabulary in (spark.createDataFrame(table, "term string, kind string, weight double"), table):
        for r in url_vocab.judge_urls(pages, [], vocabulary).collect():
            text = re.sub("%([0-7][0-9A-Fa-f])", lambda m: chr(int(m[1], 16)), urls[r.page_id] or "").lower()
            hit = {w: len(re.findall(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", text)) for w in words}
            strict = sum(hit[w] for w in words if words[w][0] == "strict")
            soft = [w for w in words if words[w][0] == "soft" and hit[w]]
            weight = sum(words[w][1] for w in soft)
            assert (r.n_strict, r.n_soft, r.soft_weight) == (strict, len(soft), weight), text
            assert r.verdict == ("block" if strict or len(soft) >= 2 and weight >= 2 else "allow")
    assert {r.verdict for r in url_vocab.judge_urls(pages, [], []).collect()} == {"allow"}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(s + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_spans(hard):
    for r in secrets.find_secrets(hard).where("doc_id is not null").collect():
        want = base_spans(TEXTS[r.doc_id])
        assert [tuple(x) for x in r.base] == want and set(want) <= {tuple(x) for x in r.found}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))


def test_linked_parts(spark):
    texts = ["user: alice password = hunter2hunter2", "user: alice and nothing else", "https://db.example.org/x " + "z" * 400 + " password = hunter2hunter2", "AKIA" + "A" * 16 + " goes with Ab1" + "Cd2" * 12, "Ab1" + "Cd2" * 12]
    got = {r.doc_id: [x.kind for x in r.found] for r in secrets.find_secrets(docs_of(spark, texts)).collect()}
    assert got == {0: ["user", "assign"], 1: [], 2: ["assign"], 3: ["access", "mixed"], 4: []}
    links = {r.doc_id: [(x.span.kind, x.part.kind) for x in r.links] for r in secrets.find_secrets(docs_of(spark, texts)).collect()}
    assert links == {0: [("user", "assign")], 1: [], 2: [], 3: [("mixed", "access")], 4: []}


def test_secrets_of_one_text_with_many(spark):
    """Places in a text of many matches, beyond one chunk; time grows about with their number."""
    import time

    took = []
    for n in (1_000, 4_000):
        text = "\n".join(f"é line {i} user: name{i} password = hunter{i:06d}" for i in range(n))
        began = time.time()
        r = secrets.find_secrets(docs_of(spark, [text])).collect()[0]
        took.append(time.time() - began)
        assert [tuple(x) for x in r.base] == base_spans(text) and r.n_assign == n and len(r.links) >= n
    assert took[1] < 10 * took[0] + 5


def test_secret_digest(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in secrets.op9_query(spark, sf).collect():
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


@pytest.mark.parametrize("values", [[], [0], [5] * 9, [2**63, 0, 7], list(range(5000)), [1] * 100 + [2**40], [3, 9, 49151] * 1400])
def test_blocks_round_trip(values):
    v = np.array(values, np.uint64)
    data = b"xx" + token_blocks.encode_block(v) + b"yy"
    got, at = token_blocks.decode_block(data, 2)
    assert got.tolist() == values and at == len(data) - 2


def test_token_digest(spark, hard):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_blocks.tokenizer_path())
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in hard.select("doc_id", "text").collect())
    start, want = 0, []
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        want.append((max(i, 0), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_blocks.token_digest(hard).collect()) == sorted(want)


def test_token_files_of_bounded_size(spark, tmp_path):
    """Files of a few ids each give the same digest as one; a block run of one too."""
    docs = docs_of(spark, [f"some words {i} " * (i % 7) for i in range(60)] + [LONG, None])
    folder, whole = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    files = token_blocks.write_token_files(docs, folder, token_blocks.tokenizer_path(), tasks=3, most=50)
    one = token_blocks.write_token_files(docs, whole, token_blocks.tokenizer_path(), tasks=1)
    assert files.count() > 3 == 3 * one.count()
    assert sorted(tuple(r) for r in token_blocks.read_token_files(files, folder).collect()) == sorted(tuple(r) for r in token_blocks.read_token_files(one, whole).collect())
    with open(f"{tmp_path}/b/{one.first().file}", "rb") as f:
        runs = [list(token_blocks.read_file(f, n)) for n in (1, 64)]
    assert [np.concatenate([r[2] for r in x]).tolist() for x in runs][0] == np.concatenate([r[2] for r in runs[1]]).tolist() and len(runs[0]) >= len(runs[1])


def test_token_query(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_blocks.tokenizer_path())
    start, want = 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_blocks.op7_query(spark, sf).collect()) == want


def test_block_max_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(400):
        terms = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.random(len(terms)) + 0.1
        vectors.append((terms, w / np.sqrt((w * w).sum()) if len(w) else w))
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    dense = np.zeros((400, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(60):
        if len(vectors[i][0]):
            score = np.round(dense @ dense[i], 9)
            score[i] = 0
            want = sorted((-s, j) for j, s in enumerate(score) if s > 0)[:8]
            assert [(pytest.approx(-s, abs=2e-9), j) for s, j in want] == index.nearest(*vectors[i], 8, skip=i) or [round(-s, 6) for s, _ in want] == [round(s, 6) for s, _ in index.nearest(*vectors[i], 8, skip=i)]


def test_term_counts_do_not_depend_on_slices():
    table = pa.table({"text": ["vile words here", "fine words here", "fine day", "calm day words", None], "toxic": pa.array([1, 0, 0, 0, 1], pa.int32())})

    def counts(rows):
        out = {}
        for batch in toxicity._term_labels(iter(table.to_batches(max_chunksize=rows))):
            for r in batch.to_pylist():
                a, m = out.get(r["term"], (0, 0))
                out[r["term"]] = a + r["pos"], m + r["n"]
        return out

    assert counts(1) == counts(2) == counts(5)
    assert (1, 3) in counts(1).values() and (0, 1) in counts(5).values()  # words; calm


def test_vocabulary_is_whole(spark):
    """Each of 300 toxic words and of the clean ones is a term, more than any fixed number of places; a word counts once."""
    import itertools

    roots = ["".join(x) for x in itertools.islice(itertools.permutations("bcdfghjk", 5), 300)]
    texts = [f"{roots[i % 300]} {roots[(i + 1) % 300]} zzz" for i in range(1500)] + [f"calm{chr(97 + i % 20)} quiet" for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i < 1500)) for i in range(3000)], "doc_id long, toxic int")
    model, counts = toxicity.fit(docs_of(spark, texts), labels, limit=3)
    rows = {r.doc_id: r for r in counts.collect()}
    assert len(model.terms) > 300
    assert all(sum(rows[i].counts) == len(texts[i].split()) for i in rows)  # a word once, and none left out
    assert min(model.score(r.terms, r.counts)[0] for i, r in rows.items() if i < 1500) > 0.7 > 0.3 > max(model.score(r.terms, r.counts)[0] for i, r in rows.items() if i >= 1500)


def test_term_frequencies_are_counted_in_the_task(spark):
    """1,500 copies that hold 40 terms each: one row a term and task, not a row a term and copy; the counts are whole."""
    rows = [(list(range(40)),)] * 1500 + [([3, 50],), ([],), ([],)]
    frame = spark.createDataFrame(rows, "terms array<int>").repartition(3)
    held = frame.mapInArrow(lambda b: toxicity._frequencies(b, 60), "t int, n long")
    found = held.collect()
    assert len(found) <= 3 * 41
    assert {r.t: r.s for r in held.groupBy("t").agg(F.sum("n").alias("s")).collect()} == {i: 1500 + (i == 3) for i in range(40)} | {50: 1}
    empty = spark.createDataFrame([], "terms array<int>").mapInArrow(lambda b: toxicity._frequencies(b, 0), "t int, n long")
    assert empty.collect() == []


def test_fit_makes_no_row_a_document_and_term(spark, monkeypatch):
    """The step that counts documents of a term takes no table of all (document, term) pairs."""
    made = []
    monkeypatch.setattr(F, "explode", lambda *a, make=F.explode: made.append(a) or make(*a))
    docs = docs_of(spark, ["vile awful words", "calm quiet words"] * 30)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    model, counts = toxicity.fit(docs, labels, limit=3)
    df = np.zeros(len(model.terms))
    for r in counts.collect():
        df[list(r.terms)] += 1
    assert len(df) and np.allclose(model.idf, np.log(61 / (df + 1)) + 1) and not made


def _bytes_of(text):
    return [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]


def _terms_of(word):
    return [(0, word)] + [(n, word[:n]) for n in toxicity.PREFIXES if len(word) >= n]


def brute_scores(docs, labels, limit, k):
    """Scores by dense cosines over all terms that pass the chi-square limit; docs {id: text}, labels {id: toxic}."""
    ids = [i for i in docs if i in labels]
    n, p = len(ids), sum(labels[i] for i in ids)
    seen = {}
    for i in ids:
        for term in {x for w in _bytes_of(docs[i]) for x in _terms_of(w)}:
            a, m = seen.get(term, (0, 0))
            seen[term] = a + labels[i], m + 1
    chi = {}
    for term, (a, m) in seen.items():
        c = n * (a * n - m * p) ** 2 / (m * max(n - m, 0.5) * p * (n - p))
        if c > limit and (a if a * n > m * p else m - a) >= toxicity.SEEN:
            chi[term] = c
    def vector(text):
        out = {}
        for w in _bytes_of(text):
            found = [x for x in _terms_of(w) if x in chi]
            if found:
                best = max(found, key=lambda x: chi[x])
                ties = [x for x in found if chi[x] == chi[best]]
                out.setdefault(tuple(ties), 0)
                out[tuple(ties)] += 1
        return out
    return ids, chi, {i: vector(t) for i, t in docs.items()}


def test_vocabulary_and_vectors_by_brute_force(spark):
    """Terms, their chi-square and the counts of every document of sf0.001, and the scores from dense cosines."""
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if toxicity.crc_fold(r.doc_id) != 1}
    ids, chi, vectors = brute_scores(docs, labels, 5, toxicity.NEAREST)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model, counts = toxicity.fit(frame, table, limit=5)
    assert len(model.terms) == len(chi) > 0
    rows = {r.doc_id: r for r in counts.collect()}
    assert {i: sum(v.values()) for i, v in vectors.items()} == {i: sum(r.counts) for i, r in rows.items()}
    # idf, unit vectors, all cosines, the k nearest with ties by number
    df = np.zeros(len(model.terms))
    for r in rows.values():
        df[list(r.terms)] += 1
    assert np.allclose(model.idf, np.log((len(rows) + 1) / (df + 1)) + 1)
    dense = np.zeros((len(model.ids), len(model.terms)))
    for x, (terms, weights) in enumerate(model.vectors):
        dense[x, terms] = weights
    for r in toxicity.toxicity(frame, table, limit=5).collect():
        terms, n = np.array(rows[r.doc_id].terms, int), np.array(rows[r.doc_id].counts, float)
        if not len(terms):
            assert r.score == model.empty and r.evidence == []
            continue
        w = (1 + np.log(n)) * model.idf[terms]
        cosine = np.round(dense[:, terms] @ (w / np.sqrt((w * w).sum())), 9)
        best = sorted((-c, x) for x, c in enumerate(cosine) if c > 0)[: toxicity.NEAREST]
        weight = np.array([1 / (1.1 - min(-c, 1.0)) for c, _ in best])
        vote = (weight @ model.labels[[x for _, x in best]] + model.base) / (weight.sum() + 1) if best else model.base
        want = 1 / (1 + np.exp(-(model.slope * np.log(vote / (1 - vote)) + model.shift)))
        assert r.score == pytest.approx(want, abs=1e-6)


def test_scores_do_not_depend_on_batches(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.limit(400).cache()
    one = {r.doc_id: (r.score, r.evidence) for r in toxicity.toxicity(some.repartition(1), labels).collect()}
    two = {r.doc_id: (r.score, r.evidence) for r in toxicity.toxicity(some.repartition(13, "text"), labels).collect()}
    assert one == two and len(one) == 400


def test_held_out_accuracy(spark, sf):
    got = toxicity.op10_query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    for r in got:
        assert r.held_out == (toxicity.crc_fold(r.doc_id) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    one, zero = ([r.score for r in held if r.toxic == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero)) > 0.85
    assert sum(r.toxic for r in held if r.predicted) >= 0.9 * sum(r.predicted for r in held)


def test_revisits(spark):
    rows = [
        (1, "http://www.A.org/x/?utm_source=q#f", 100, "response", {"ETag": '"1"', "X": "r", "Content-Type": "t"}, None), (2, "https://a.org/x", 200, "revisit", {"etag": 'W/"1"', "x": "v", "Age": "3"}, None),
        (3, "https://a.org/x", 90, "revisit", {"etag": '"1"'}, None), (4, "https://a.org/x", 50_000, "revisit", {"ETAG": '"2"'}, None), (5, "https://a.org/x", 90_000, "revisit", {}, None), (6, None, 100, "revisit", None, None),
        (7, "https://a.org/y", 100, "response", None, "d"), (8, "https://a.org/y", 100, "revisit", None, "d"), (9, "https://a.org/y", 900_000, "revisit", None, "e"), (8, "https://a.org/y", 100, "revisit", None, "d"), (10, "https://a.org/y", None, "revisit", None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, type string, headers map<string,string>, digest string").withColumn("ts", F.timestamp_seconds("s")).withColumn("span", F.lit(1)).withColumn("far", F.lit(1))
    got = {r.record_id: r for r in warc.resolve(df).collect()}
    assert {k: (r.status, r.response_id) for k, r in got.items()} == {
        2: ("resolved", 1), 3: ("orphan", None), 4: ("mismatch", None), 5: ("unchecked", 1), 6: ("orphan", None), 8: ("resolved", 7), 9: ("mismatch", None), 10: ("orphan", None),
    }
    assert got[2].headers == {"etag": 'W/"1"', "x": "r", "content-type": "t", "age": "3"}
    assert warc.resolve(df).count() == 9 and warc.resolve(df.limit(0)).count() == 0


def test_warc_round_trip():
    records = [{"type": "response", "url": "http://a/", "date": "2024-01-01T00:00:00Z", "id": "1", "headers": {"ETag": "x"}, "body": b"\r\n\r\nbody\x00"}, {"type": "revisit", "url": "http://a/", "date": "2024-01-02T00:00:00Z", "id": "2", "headers": {}, "body": b""}]
    data = warc.write_warc(records)
    assert list(warc.read_warc(data)) == records and list(warc.read_warc(data[: len(warc.write_warc(records[:1])) + 40])) == records[:1] and list(warc.read_warc(b"")) == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), sf, queries.ORACLE_SQL[name])


def test_words_and_slices():
    texts = [t or "" for t in TEXTS if t is not LONG]
    for limit in (1, 50, 1 << 20):
        got = []
        for _, data, offsets in A.text_slices(pa.array(texts), limit):
            starts, ends, rows = A.word_spans(data, offsets)
            raw = data.tobytes()
            for r in range(len(offsets) - 1):
                got.append([raw[s:e].decode() for s, e, x in zip(starts, ends, rows) if x == r])
        assert got == [WORD.findall(t) for t in texts]


@pytest.mark.parametrize("n", [1, 7, 60, 10_000])
def test_labelled_rows_teach_the_same_list(spark, n):
    """Statistics of only the rows that can be sampled give the list that those of all rows give, with repeated rows and labels too."""
    docs = docs_of(spark, [" ".join(f"w{i}{j}" for j in range(20)) + " #" * (30 if i % 3 == 0 else 0) for i in range(120)])
    docs = docs.union(docs.where("doc_id % 4 = 0"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 200, 2)] + [(None, 0), (6, None), (12, 0)], "doc_id long, quality int")
    few = quality.labelled(docs, labels, n)
    assert few.select("doc_id").distinct().count() <= n
    assert quality.train(quality.text_statistics(few), labels, n) == quality.train(quality.text_statistics(docs), labels, n)
