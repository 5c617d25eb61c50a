import hashlib
import re
import zlib

import corpus_pipeline as C
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import TEXTS, WORD, components, counts_of, docs_of

from tessera.llm import mixing, quality, token_blocks
from tessera.llm.shared import written

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(rows before, rows after) of each stage on the small tables."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in C.STAGES:
        after = written(stage(spark, docs, SMALL), name)
        out[name] = docs.orderBy("doc_id").collect(), after.orderBy("doc_id").collect()
        if name != "token_output":
            assert after.columns == docs.columns
        docs = after
    return out


def features_of(text):
    n_words, chars, symbols, dup, repeats = counts_of(text)
    raw = text.encode()
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or 0xC2 <= b < 0xF5 for b in raw)
    share = lambda a, b: a / max(b, 1)
    return {
        "n_words": n_words, "mean_word": share(chars, n_words), "symbols": share(symbols, n_words), "dup_lines": share(dup, lines), "repeats": share(repeats, n_words),
        "upper": share(sum(65 <= b <= 90 for b in raw), letters), "digits": share(sum(48 <= b <= 57 for b in raw), chars), "calls": share(text.count("!") + text.count("?"), n_words), "line_words": share(n_words, lines),
    }, n_words < 10 or 100 * repeats > 20 * n_words


def test_quality_stage(spark, stages):
    before, after = stages["quality_rules"]
    rules = quality.train(quality.text_statistics(spark.read.parquet(f"{SMALL}/documents.parquet")), spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = []
    for r in before:
        f, failed = features_of(r.text or "")
        if not failed and not any(all(f[n] >= v if at_least else f[n] < v for n, at_least, v in rule.tests) for rule in rules):
            want.append(r.doc_id)
    assert [r.doc_id for r in after] == want and 0 < len(want) < len(before)


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]
    label = components([r.text for r in before], 5, 4, 5)
    assert [r.doc_id for r in after] == sorted({before[c].doc_id for _, c in label}) and len(after) < len(before)


def test_decontaminate_stage(spark, stages):
    """What holds an item goes, in any case; nothing goes that shares no 5 words with any."""
    before, after = stages["decontaminate"]
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 5]) for w in items for i in range(len(w) - 4)}
    kept = {r.doc_id for r in after}
    for r in before:
        w = words(r.text)
        whole = any(" ".join(x) in " ".join(w) for x in items)
        assert not (whole and r.doc_id in kept)
        if r.doc_id not in kept:
            assert grams & {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def topic_of(t):
    if " | " in t:
        return "table"
    if "Licensed under" in t or "is licensed under" in t:
        return "license"
    if "###" in t or "$$$" in t or "!!" in t:
        return "noise"
    return "note" if len(t) < 400 else "article" if len(t) < 4000 else "long"


def test_mix_stage(stages):
    """Raking and calibration in numpy over the same cells, and each document's coin."""
    before, after = stages["mix_sources"]
    cell = [(r.source, r.lang, topic_of(r.text or "")) for r in before]
    n = [len(WORD.findall(r.text or "")) for r in before]
    cells = sorted(set(cell))
    tokens = np.array([sum(x for x, c in zip(n, cell) if c == d) for d in cells], float)
    weight = tokens / tokens.sum()
    margins = []
    for m in range(3):
        keys = [c[m] for c in cells]
        goal = {k: tokens[[x == k for x in keys]].sum() ** mixing.POWER for k in set(keys)}
        margins.append((keys, {k: v / sum(goal.values()) for k, v in goal.items()}))
    for _ in range(400):
        for keys, goal in margins:
            for k, share in goal.items():
                at = np.array([x == k for x in keys])
                weight[at] *= share / weight[at].sum() if weight[at].sum() else 0
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (tokens * np.minimum(1, mid * weight / tokens)).sum() < mixing.BUDGET * tokens.sum() else (lo, mid)
    p = dict(zip(cells, np.minimum(1, lo * weight / tokens)))
    kept = {x.doc_id for x in after}
    for r, c in zip(before, cell):
        u = int(hashlib.md5(f"{r.doc_id}\x1f{r.text}".encode()).hexdigest()[:13], 16) / 2**52
        if abs(u - p[c]) > 1e-3:
            assert (r.doc_id in kept) == (u < p[c])
    assert 0 < len(after) < len(before)


def test_token_stage(stages):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(token_blocks.tokenizer_path()), 0
    for r, got in zip(*stages["token_output"], strict=True):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_on_hard_rows(spark, name):
    """Nulls, empty and long texts, copies, a repeated row, clashing columns; and an empty table."""
    docs = docs_of(spark, TEXTS)
    docs = docs.union(docs.where("doc_id = 9")).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    stage = dict(C.STAGES)[name]
    out = stage(spark, docs, SMALL)
    rows, n = out.collect(), docs.count()
    if name == "token_output":
        assert len(rows) == n
    else:
        assert out.columns == docs.columns and {r.doc_id for r in rows} <= {*range(len(TEXTS)), None}
    if name == "near_duplicates":
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == sorted({-1, *(c for _, c in components(TEXTS, 5, 4, 5))})
    if name == "decontaminate":
        assert len(rows) == n
    if name == "quality_rules":
        assert all(r.text and len(WORD.findall(r.text)) >= 10 for r in rows)
    if name == "mix_sources":
        assert sum(r.doc_id == 9 for r in rows) in (0, 2)
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_run(spark):
    assert C.run(spark, SMALL).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
