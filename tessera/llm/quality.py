"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text are taken with numpy (see ``arrays``).  Sequential
covering learns the list from labelled statistics: a rule is a conjunction of
thresholds, grown on two thirds of the rows by information gain, pruned on the
rest; rows that a rule covers are set aside and the next rule is grown.  The list
is emitted as one ordered Spark conditional expression.

The learner sees at most ``sample`` labelled rows (those with the smallest hash
of doc_id), a documented bound; statistics and verdicts cover all rows.

Edge cases: null texts count as empty and fail the base rules; labels that are
null or whose document is missing are ignored; several labels of a document each
count; with no labels or one class the list is empty and keeps what the base
rules keep; of equal gains the first feature and the lowest threshold are taken; very long texts
are read whole, a task holds one beside a MB of others; repeated rows each get their row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .shared import hash_sample, ship, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC2, 0xF5)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_CALLS = np.zeros(256, bool)
_CALLS[ord("!")] = _CALLS[ord("?")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_calls", "n_lines"]
FEATURES = ["n_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "calls", "line_words"]


def _repeat_words(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> np.ndarray:
    """For each row the words that lie in k-word windows found twice or more in it."""
    windows = A.window_hashes(hashes, k)
    if not len(windows):
        return np.zeros(n_rows, np.int64)
    inside = rows[: len(windows)] == rows[k - 1 :]
    own = A.mix(windows ^ A.mix(rows[: len(windows)].astype(np.uint64) + np.uint64(1)))
    at = np.flatnonzero(inside)
    order = np.argsort(own[at], kind="stable")
    sorted_ = own[at][order]
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        equal = sorted_[1:] == sorted_[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    cover = np.zeros(len(hashes) + k, np.int32)
    hits = at[order[same]]
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + k, -1)
    return np.bincount(rows[np.cumsum(cover[: len(hashes)]) > 0], minlength=n_rows)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its lines with a word that equal an earlier line of it, and its lines with a word."""
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    bounds = bounds[bounds < len(data)]
    if not len(bounds):
        return np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    row = np.searchsorted(offsets, bounds, "right") - 1
    stop = np.minimum(np.append(bounds[1:], len(data)), offsets[row + 1])
    stop = np.where((stop > bounds) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop)
    has_word = np.searchsorted(starts, stop) > np.searchsorted(starts, bounds)
    bounds, stop, row = bounds[has_word], stop[has_word], row[has_word]
    own = A.mix(A.span_hashes(data, bounds, stop) ^ A.mix(row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(own, return_index=True)
    again = np.ones(len(own), bool)
    again[first] = False
    return np.bincount(row[again], minlength=n_rows), np.bincount(row, minlength=n_rows)


def text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the counts of ``row.text`` to each ``row``."""
    for batch in batches:
        parts = [[] for _ in COUNTS]
        for _, data, offsets in A.text_slices(batch.column("row").field("text")):
            starts, ends, rows = A.word_spans(data, offsets)
            n_rows = len(offsets) - 1
            hashes = A.span_hashes(data, starts, ends)
            dup, lines = _dup_lines(data, offsets, starts, rows)
            points = (data & 0xC0) != 0x80
            values = [
                np.bincount(rows, minlength=n_rows),
                A.row_sums(points & ~A.SPACE[data], offsets),
                A.row_sums(SYMBOLS[data], offsets),
                dup,
                _repeat_words(hashes, rows, n_rows),
                *(A.row_sums(table[data], offsets) for table in (_UPPER, _LETTER, _DIGIT, _CALLS)),
                lines,
            ]
            for part, v in zip(parts, values):
                part.append(v)
        arrays = [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64()) for p in parts]
        kept = batch.column("row")
        if "doc_id" in batch.schema.names:  # the text itself is not wanted back
            kept = batch.column("doc_id")
        yield pa.record_batch([kept, *arrays], names=["doc_id" if "doc_id" in batch.schema.names else "row", *COUNTS])


def text_statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id (whole: the whole row, as ``row``) and the counts of every row; the first five are those of the query's contract."""
    ship(docs.sparkSession)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    if whole:
        packed = docs.select(F.struct("*").alias("row"))
        return packed.mapInArrow(text_counts, f"row {packed.schema['row'].dataType.simpleString()}, {counts}")
    packed = docs.select(F.struct(F.col("text").cast("string").alias("text")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return packed.mapInArrow(text_counts, f"doc_id long, {counts}")


def features() -> dict[str, Column]:
    """Ratios that do not depend on the length of a text, by name."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "n_letters"),
        "digits": share("n_digits", "word_chars"),
        "calls": share("n_calls", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """Reject where all (feature, is at least, threshold) hold."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int


def _covers(x: np.ndarray, tests: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_least, v in tests:
        out &= (x[:, f] >= v) if at_least else (x[:, f] < v)
    return out


def _best_test(x: np.ndarray, bad: np.ndarray) -> tuple[int, bool, float] | None:
    """The threshold with the largest gain p * (log p/(p+n) - log P/(P+N)) over rows x."""
    total, rows = bad.sum(), len(bad)
    best, found = 1e-9, None
    base = np.log2(max(total, 1e-9) / rows)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        below = np.cumsum(b)[cut - 1]
        for at_least, p, n in ((True, total - below, rows - cut), (False, below, cut)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / n) - base)
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], (f, at_least, float((v[cut[i] - 1] + v[cut[i]]) / 2))
    return found


def learn_list(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, support: int = 5, max_rules: int = 12, max_tests: int = 4) -> list[Rule]:
    """Sequential covering: ordered reject rules whose precision on held-out rows is at least ``precision``."""
    rules: list[Rule] = []
    fold = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < max_rules:
        grow, prune = left & ~fold, left & fold
        if bad[grow].sum() < support:
            break
        tests: list[tuple[int, bool, float]] = []
        inside = grow.copy()
        while len(tests) < max_tests and inside.any() and not bad[inside].all():
            t = _best_test(x[inside], bad[inside])
            if t is None:
                break
            tests.append(t)
            inside &= _covers(x, [t])
        if not tests:
            break

        def worth(candidate: list) -> float:
            hit = _covers(x, candidate) & prune
            p, n = bad[hit].sum(), (~bad[hit]).sum()
            return (p - n) / max(p + n, 1)

        while len(tests) > 1:
            shorter = max((tests[:i] + tests[i + 1 :] for i in range(len(tests))), key=worth)
            if worth(shorter) < worth(tests):
                break
            tests = shorter
        hit = _covers(x, tests) & left
        held = hit & fold
        good = bad[held].mean() if held.any() else 0.0
        if hit.sum() < support or good < precision:
            break
        rules.append(Rule(tuple((names[f], a, v) for f, a, v in tests), float(good), int(hit.sum())))
        left &= ~hit
    return rules


def list_expression(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0: none."""
    named, out = features(), None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, at_least, v in rule.tests:
            test = test & ((named[f] >= v) if at_least else (named[f] < v))
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def train(statistics: DataFrame, labels: DataFrame, sample: int = 20_000, **limits) -> list[Rule]:
    """The list learned from at most ``sample`` labelled documents, those with the smallest hash of doc_id."""
    labels = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    rows = statistics.join(labels, "doc_id").select("doc_id", "quality", *[c.alias(f"f_{n}") for n, c in features().items()])
    rows = hash_sample(rows, "doc_id", sample, "quality", *[f"f_{n}" for n in FEATURES]).toPandas()
    if not len(rows):
        return []
    return learn_list(rows[[f"f_{n}" for n in FEATURES]].to_numpy(float), rows["quality"].to_numpy() == 0, FEATURES, **limits)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, the counts, base_failed, rule (number of the learned rule that rejects, 0: none) and kept."""
    statistics = written(text_statistics(docs), "statistics")
    out = statistics.withColumn("base_failed", base_failed()).withColumn("rule", list_expression(train(statistics, labels, sample)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """The rows of ``docs`` that ``train`` can take: those of the ``sample`` labels with the smallest hash among labels with a document."""
    labels = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = hash_sample(labels, "doc_id", sample, "quality").select("doc_id").distinct()  # at most ``sample`` rows: may be broadcast
    return docs.join(F.broadcast(chosen), "doc_id", "left_semi")


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs``, as they are, that the base rules and the learned list keep."""
    rules = train(text_statistics(labelled(docs, labels, sample)), labels, sample)
    return text_statistics(docs, whole=True).where(~base_failed() & (list_expression(rules) == 0)).select("row.*")


def op1_query(spark, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
