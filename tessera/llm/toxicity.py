"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are lower-cased runs of letters and their first 4 to 8 bytes.  The
vocabulary are all terms that a sample of labelled documents associates with either
label (chi-square over ``LIMIT``, ``SEEN`` documents of that label at least).  A word
counts once, as that of its terms with the largest chi-square.  Document frequencies
are counted over all documents.  The examples are the sample's documents.

Each document's k nearest examples are found exactly with a block-max inverted
index: examples are numbered and cut into blocks; each term has its largest weight
in each block; blocks are taken in descending order of the sum of these bounds
until the k-th similarity is no less than the next bound.  The vote is weighted by
distance, shrunk to the base rate, and calibrated by a logistic curve fitted to the
votes of the examples themselves, each left out of its own vote.

Only the fit looks at a sample: the ``sample`` labelled documents with the smallest
hash of doc_id among those that may be learned from.  Scores cover all rows.

Edge cases: texts that are null, empty or without a term of the vocabulary get the
calibrated base rate of examples without terms; labels that are null or without
document are ignored; with no labels the score is 0.5, with one class its rate;
ties in similarity go to the lower example number; very long texts are read whole, a task holds
one beside a MB of others; repeated rows each get their row; an empty table gives an empty result;
other columns are ignored.  No result depends on how rows fall into batches, tasks or files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .shared import hash_sample, ship, written

SAMPLE, LIMIT, SEEN, NEAREST, BLOCK, PREFIXES = 8_000, 30, 3, 8, 64, (4, 5, 6, 7, 8)
_OTHER = np.ones(256, bool)
_OTHER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every word and every prefix of longer words."""
    starts, ends, rows = A.word_spans(data, offsets, _OTHER)
    hashes, out = [A.span_hashes(data, starts, ends, fold=True)], [rows]
    for n in PREFIXES:
        long = ends - starts >= n
        hashes.append(A.span_hashes(data, starts[long], starts[long] + n, fold=True) ^ np.uint64(0x5DEECE66D0000000 + n))
        out.append(rows[long])
    return np.concatenate(out), np.concatenate(hashes)


def _term_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term the documents that hold it and the toxic ones of these, within a slice: their sums are whole, however examples fall into slices."""
    for batch in batches:
        label = np.array(batch.column("toxic").to_pylist(), np.int64)
        for row, data, offsets in A.text_slices(batch.column("text")):
            rows, terms = _terms(data, offsets)
            order = np.lexsort((rows, terms))
            rows, terms = rows[order], terms[order]
            first = np.ones(len(rows), bool)
            first[1:] = (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])
            rows, terms = rows[first], terms[first]
            distinct, at = np.unique(terms, return_inverse=True)
            pos = np.bincount(at, weights=label[row + rows], minlength=len(distinct)).astype(np.int64)
            every = np.bincount(at, minlength=len(distinct))
            yield pa.record_batch({"term": pa.array(distinct.view(np.int64)), "pos": pa.array(pos), "n": pa.array(every)})


def _best_terms(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray, rank: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the term of least rank) of every word that has a term of the vocabulary."""
    starts, ends, rows = A.word_spans(data, offsets, _OTHER)
    best = np.full(len(starts), -1)
    for n in (0, *PREFIXES):
        at = np.flatnonzero(ends - starts >= n)
        h = A.span_hashes(data, starts[at], starts[at] + n, fold=True) ^ np.uint64(0x5DEECE66D0000000 + n) if n else A.span_hashes(data, starts, ends, fold=True)
        hit = np.flatnonzero(may[h >> np.uint64(44)])
        at, h = at[hit], h[hit]
        t = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
        hit = terms[t] == h if len(terms) else np.zeros(0, bool)
        at, t = at[hit], t[hit]
        better = (best[at] < 0) | (rank[t] < rank[best[at]]) if len(at) else np.zeros(0, bool)
        best[at[better]] = t[better]
    return rows[best >= 0], best[best >= 0]


def _vectors(batches: Iterator[pa.RecordBatch], terms: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbers and counts of the vocabulary's terms in each text, ascending by number."""
    may = np.zeros(1 << 20, bool)
    may[terms >> np.uint64(44)] = True
    for batch in batches:
        numbers, counts = [], []
        for _, data, offsets in A.text_slices(batch.column("text")):
            n_rows = len(offsets) - 1
            rows, found = _best_terms(data, offsets, terms, rank, may)
            key, count = np.unique(rows.astype(np.int64) * max(len(terms), 1) + found, return_counts=True)
            bounds = np.searchsorted(key, np.arange(n_rows + 1) * max(len(terms), 1))
            number = key % max(len(terms), 1)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                numbers.append(number[a:b])
                counts.append(count[a:b])
        yield pa.record_batch([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=[*[c for c in batch.schema.names if c != "text"], "terms", "counts"])


def _frequencies(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    """The terms of this task's rows and how many rows hold each: a row a term, however many rows there are."""
    total = np.zeros(n_terms, np.int64)
    for batch in batches:
        total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=n_terms)
    found = np.flatnonzero(total)
    yield pa.record_batch({"t": pa.array(found, pa.int32()), "n": pa.array(total[found])})


class BlockMaxIndex:
    """Inverted lists of unit vectors with the largest weight of each term in each block of examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.n_blocks = -(-self.n // block)
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        docs = np.repeat(np.arange(self.n), sizes)
        of = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int64)
        weights = np.concatenate([w for _, w in vectors] or [np.zeros(0)]).astype(float)
        order = np.lexsort((docs, of))  # lists of the terms, one after the other
        self.docs, self.weights, of = docs[order], weights[order], of[order]
        cell = of * self.n_blocks + self.docs // block
        edges = np.arange(n_terms)[:, None] * self.n_blocks + np.arange(self.n_blocks + 1)
        self.starts = np.searchsorted(cell, edges)
        self.most = np.zeros((n_terms, self.n_blocks), np.float64)
        np.maximum.at(self.most, (of, self.docs // block), self.weights)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """(similarity, example) of the k most similar with a similarity over 0, most similar first, ties by number."""
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        at, step, starts = 0, 4, self.starts[terms]
        while at < len(order):  # some blocks at a time, more as it goes on
            chosen = order[at : at + step]
            chosen = chosen[bound[chosen] > 0]
            if not len(chosen) or len(best) == k and bound[chosen[0]] + 1e-9 < -best[-1][0]:
                break
            at, step = at + step, step * 2
            i, j = starts[:, chosen].ravel(), starts[:, chosen + 1].ravel()
            n = (j - i).astype(np.int64)
            places = np.repeat(i - np.cumsum(n) + n, n) + np.arange(n.sum())
            score = np.bincount(self.docs[places], self.weights[places] * np.repeat(np.repeat(weights, len(chosen)), n), self.n)
            score = np.round(score, 9)
            if 0 <= skip < self.n:
                score[skip] = 0
            found = np.flatnonzero(score > 0)
            if len(found) > k:  # only what may be among the k most similar
                found = found[score[found] >= np.partition(score[found], -k)[-k]]
            best += [(-float(score[x]), x) for x in found.tolist()]
            best.sort()
            del best[k:]
        return [(-s, i) for s, i in best]


class Model:
    """The fitted scorer; small, and the same for every document."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST):
        self.terms, self.idf, self.ids, self.labels, self.k = terms, idf, ids, labels, k
        self.vectors = [self.unit(*v) for v in vectors]
        self.index = BlockMaxIndex(self.vectors, len(terms))
        empty = np.array([not len(v[0]) for v in vectors], bool)
        rate = lambda y, prior: (y.sum() + 2 * prior) / (len(y) + 2)
        self.base = float(labels.mean()) if len(labels) else 0.5
        self.empty = float(rate(labels[empty], self.base)) if len(labels) else 0.5
        self.slope, self.shift = 1.0, 0.0
        if len(labels) and 0 < labels.sum() < len(labels):
            votes = np.array([self.vote(*v, skip=i)[0] for i, v in enumerate(self.vectors) if len(v[0])])
            self.calibrate(votes, labels[~empty])

    def unit(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        terms = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, float))) * self.idf[terms] if len(terms) else np.zeros(0)
        return terms, w / np.sqrt((w * w).sum()) if len(terms) else w

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, list[int]]:
        """Share of toxic examples weighted by 1 / (0.1 + cosine distance), shrunk to the base rate; the examples' numbers."""
        found = self.index.nearest(terms, weights, self.k, skip)
        w = np.array([1 / (1.1 - min(s, 1.0)) for s, _ in found])
        y = self.labels[[i for _, i in found]]
        return float((w @ y + self.base) / (w.sum() + 1)) if found else self.base, [i for _, i in found]

    def calibrate(self, votes: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
        """Logistic regression on the votes' logits, with a small ridge to slope 1."""
        x = np.log(votes / (1 - votes)) if len(votes) else votes
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + 0.1 * b])
            q = p * (1 - p)
            h = np.array([[(q * x * x).sum() + 1, (q * x).sum()], [(q * x).sum(), q.sum() + 0.1]])
            d = np.linalg.solve(h, g)
            a, b = a - d[0], b - d[1]
            if abs(d).max() < 1e-9:
                break
        self.slope, self.shift = (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[int]]:
        if not len(terms) or not len(self.labels):
            return self.empty, []
        vote, found = self.vote(*self.unit(terms, counts))
        return float(1 / (1 + np.exp(-(self.slope * np.log(vote / (1 - vote)) + self.shift)))), self.ids[found[:3]].tolist()


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, tuple[float, list[int]]] = {}
    for batch in batches:
        scores, evidence = [], []
        terms, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts"))
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([0, *ends[:-1]], ends):
            key = terms[a:b].tobytes(), counts[a:b].tobytes()
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                known[key] = model.score(terms[a:b], counts[a:b])
            s, e = known[key]
            scores.append(s)
            evidence.append(e)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()), "evidence": pa.array(evidence, pa.list_(pa.int64()))})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = LIMIT, k: int = NEAREST) -> tuple[Model, DataFrame]:
    """The model, and the term counts of all documents that it scores."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    chosen = hash_sample(chosen, "doc_id", sample, "toxic")  # so small that it may be broadcast
    examples = written(docs.join(F.broadcast(chosen), "doc_id"), "examples")
    if not (size := examples.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()).n:
        size = None
    terms = np.zeros(0, np.uint64)
    if size:
        n, p = float(size.n), float(size.p)
        seen = examples.mapInArrow(_term_labels, "term long, pos long, n long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("n").alias("m"))
        a, m = F.col("a"), F.col("m")
        chi = n * F.pow(a * n - m * p, 2) / (m * F.greatest(n - m, F.lit(0.5)) * max(p, 0.5) * max(n - p, 0.5))
        enough = F.when(a * n > m * p, a).otherwise(m - a) >= SEEN
        best = seen.where(enough).withColumn("chi", chi).where(F.col("chi") > limit)
        best = best.orderBy(F.desc("chi"), "term").collect()  # of a bounded sample
        terms = np.array([r.term for r in best], np.int64).view(np.uint64)
    rank = np.argsort(terms)
    terms = terms[rank]
    counts = written(docs.mapInArrow(lambda b: _vectors(b, terms, rank), "doc_id long, terms array<int>, counts array<int>"), "terms")
    own = examples.mapInArrow(lambda b: _vectors(b, terms, rank), "doc_id long, toxic int, terms array<int>, counts array<int>").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "terms", "counts").collect()
    n_docs = counts.count()
    idf = np.full(len(terms), np.log(n_docs + 1.0) + 1)
    held = counts.select("terms").mapInArrow(lambda b: _frequencies(b, len(terms)), "t int, n long")
    for r in held.groupBy("t").agg(F.sum("n").alias("n")).collect():  # a row a term of the vocabulary
        idf[r.t] = np.log((n_docs + 1) / (r.n + 1)) + 1
    model = Model(terms, idf, np.array([r.doc_id for r in own], np.int64), np.array([r.toxic for r in own], np.int64), [(r.terms, r.counts) for r in own], k)
    return model, counts


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, score and evidence (doc_ids of the nearest examples) of every row of ``docs``; learned from ``labels`` (doc_id, toxic)."""
    model, counts = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a small table of few files, and much work a row
    counts = counts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return counts.mapInArrow(lambda b: _score(b, shared.value), "doc_id long, score double, evidence array<long>")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_query(spark, sf_dir: str) -> DataFrame:
    """The score of every document, learned without the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
