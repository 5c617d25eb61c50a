"""Benchmark decontamination by template canonicalisation.

Texts are cut into tokens of letters and digits, A-Z folded.  Numbers, names
(capitalised words inside a sentence) and units (after a number) become typed
placeholders, so a question with other numbers or names keeps its template.
Windows of ``width`` template tokens of every document are joined by hash with
those of the benchmark items; a shorter item is one window of its own length.

Every text has three readings, compared apart.  In the first a capitalised word that
begins a sentence is a word like others, and each name is one placeholder.  In the
second such a word may be a name too, and a run of names is one placeholder, so
names may change at the start of a sentence and in length.  In the third no word is a
name, so a copy in other case has the item's template.  Of the second and third reading those windows
count of which at least half is not placeholders; a window of the first of which four
fifths or more are placeholders tells nothing by its template, so its values belong to its hash.

A document and an item are compared along matching windows whose shifts (place in
the document less place in the item) are at most ``NEAR`` apart, each after the one
before in both texts; so some words may be put in or left out.  The replaced values should map one to one (slot consistency): each item
value goes to the value that most of its occurrences became, and of item values that
became one value only that with most occurrences keeps it (with equally many none
does; a value that stayed the same goes first).  A window agrees if it follows this
mapping or has the item's own values.  The pair is contaminated if enough of the
item's windows agree.

A bit filter of fixed size over the benchmark's window hashes keeps other windows
out of the join; the join itself broadcasts the benchmark only if it has at most
``BROADCAST_ROWS`` windows, else both sides are shuffled.

Edge cases: null and empty texts and items have no windows and match nothing;
items with fewer than ``LEAST`` tokens are not searched; equal items and
repeated documents each give their pairs once; null ids are skipped (``clean_documents``
judges rows by id and text, so it needs no id); very long texts are read whole, a task holds one at a time;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .shared import hash_filter, may_hold, ship, written

WIDTH, LEAST, NEAR, FILTER_BITS, BROADCAST_ROWS = 10, 5, 8, 22, 200_000
UNITS = (
    "kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mile miles mi ft foot feet inch inches yard yards s sec second seconds min minute minutes h hr hour hours day days"
    " week weeks month months year years usd eur gbp dollar dollars euro euros pound pounds cent cents percent l ml liter liters litre litres gallon gallons w kw mw watt watts"
    " v volt volts hz mhz ghz b kb mb gb tb degree degrees c f k mph kmh"
).split()
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x1111222233334444, 0x5555666677778888, 0x9999AAAABBBBCCCC))
_READING = [np.uint64(x) for x in (0, 0x2468ACE013579BDF, 0x1357BDF02468ACE9)]  # tells windows of the readings
_OTHER = np.ones(256, bool)
_OTHER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:\n\"|"]] = True


def template_tokens(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of three readings, per token: its row, the hash of its template, the hash of its value, whether it is a slot."""
    joins = np.zeros(len(data), bool)  # . or , between digits belongs to the number
    if len(data) > 2:
        joins[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    view = np.where(joins, ord("0"), data).astype(np.uint8)
    starts, ends, rows = A.word_spans(view, offsets, _OTHER)
    value = A.span_hashes(data, starts, ends, fold=True)
    if not len(starts):
        return [(rows, value, value, np.zeros(0, bool))] * 3
    head = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    number = _DIGIT[head]
    small = ((second >= 97) & (second <= 122)) | (second >= 0x80)
    capital = (head >= 65) & (head <= 90) & (ends - starts > 1) & small
    capital |= (head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (ends - starts > 3)
    follows = np.zeros(len(rows), bool)
    follows[1:] = rows[1:] == rows[:-1]
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_END[data], out=marks[1:])
    ended = np.ones(len(rows), bool)
    ended[1:] = marks[starts[1:]] > marks[ends[:-1]]
    name = capital & follows & ~ended
    after_number = np.zeros(len(rows), bool)
    after_number[1:] = number[:-1] & follows[1:]
    units = _unit_hashes()
    unit = after_number & (units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value)
    template = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    first = rows, template, value, number | unit | name
    third = rows, np.where(name & ~unit, value, template), value, number | unit
    capital &= ~unit
    template = np.where(capital, _NAME, np.where(name, value, template))
    starts_run = np.ones(len(rows), bool)
    starts_run[1:] = ~(capital[1:] & capital[:-1] & follows[1:] & ~ended[1:])
    at = np.flatnonzero(starts_run)
    place = (np.arange(len(rows)) - at[np.cumsum(starts_run) - 1]).astype(np.uint64)
    value = np.add.reduceat(np.where(place > 0, A.mix(value + place), value), at)
    return [first, (rows[at], template[at], value, (number | unit | capital)[at]), third]


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = A.word_spans(data, np.array([0, len(data)]))
    return np.sort(A.span_hashes(data, starts, ends))


def _windows(batches: Iterator[pa.RecordBatch], width: int, lengths: list[int], bits: np.ndarray | None, own_only: bool) -> Iterator[pa.RecordBatch]:
    """Windows (id, pos, hash, slots): of documents those whose hash the filter may hold, of items (own_only) all.

    slots: value hashes of the window's slot tokens, in order; places: where in the text these tokens are.
    """
    for batch in batches:
        ids = batch.column(0)
        out_id, out_pos, out_hash, out_reading, out_total, out_w, out_slots, out_places = [], [], [], [], [], [], [], []
        for row, data, offsets in A.text_slices(batch.column("text")):
            for reading, (rows, template, value, slot) in enumerate(template_tokens(data, offsets)):
                n_rows = len(offsets) - 1
                first = np.searchsorted(rows, np.arange(n_rows + 1))
                count = np.diff(first)
                slots_before = np.concatenate([[0], np.cumsum(slot)])
                for w in [width, *lengths]:
                    h = A.window_hashes(template, w)
                    at = np.arange(len(h))
                    good = rows[: len(h)] == rows[w - 1 :][: len(h)] if len(h) else np.zeros(0, bool)
                    if own_only and len(h):
                        good &= (count[rows[: len(h)]] == w) if w < width else (count[rows[: len(h)]] >= width)
                    if len(h):
                        n_slots = slots_before[w:] - slots_before[:-w]
                        if reading:
                            h = h ^ _READING[reading]
                            good &= 2 * n_slots <= w
                        else:
                            h = np.where(5 * n_slots >= 4 * w, A.mix(h + A.window_hashes(np.where(slot, value, template), w)), h)
                    if bits is not None and len(h):
                        good &= may_hold(bits, h)
                    for i in at[good].tolist():
                        r = int(rows[i])
                        out_id.append(row + r)
                        out_pos.append(i - int(first[r]))
                        out_hash.append(h[i].astype(np.int64))
                        out_reading.append(reading)
                        out_total.append(int(count[r]) - w + 1)
                        out_w.append(w)
                        out_slots.append(value[i : i + w][slot[i : i + w]].view(np.int64).tolist())
                        out_places.append((np.flatnonzero(slot[i : i + w]) + i - int(first[r])).tolist())
        yield pa.record_batch(
            [ids.take(pa.array(out_id, pa.int64())), pa.array(out_pos, pa.int32()), pa.array(out_hash, pa.int64()), pa.array(out_reading, pa.int32()), pa.array(out_total, pa.int32()), pa.array(out_w, pa.int32()), pa.array(out_slots, pa.list_(pa.int64())), pa.array(out_places, pa.list_(pa.int32()))],
            names=["id", "pos", "hash", "reading", "total", "w", "slots", "places"],
        )


_SCHEMA = "id long, pos int, hash long, reading int, total int, w int, slots array<long>, places array<int>"


def majority_mapping(seen: dict[tuple[int, int], set[int]]) -> dict[int, int]:
    """Item value to document value, one to one, from the places of the item at which each pair of values was seen."""
    rank = lambda p: (len(seen[p]), p[0] == p[1])
    takes: dict[int, tuple[int, int]] = {}
    for p in sorted(seen, key=lambda p: (min(seen[p]), p[1])):
        if p[0] not in takes or rank(p) > rank(takes[p[0]]):
            takes[p[0]] = p
    claims: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in takes.values():
        claims[p[1]].append(p)
    out = {}
    for ps in claims.values():
        ps.sort(key=rank, reverse=True)
        if len(ps) == 1 or rank(ps[0]) > rank(ps[1]):
            out[ps[0][0]] = ps[0][1]
    return out


def in_order(places: list[tuple[int, int]]) -> int:
    """The most (item, document) places of which each is after the one before in both texts."""
    ends: list[int] = []
    for _, d in sorted(places, key=lambda x: (x[0], -x[1])):
        at = bisect_left(ends, d)
        ends[at : at + 1] = [d]
    return len(ends)


def agreement(hits: list[dict]) -> tuple[int, int, bool, bool]:
    """Windows matched, windows that agree, whether all slot values are equal, whether all map one to one; windows in order."""
    seen: dict[tuple[int, int], set[int]] = defaultdict(set)
    for h in hits:
        for a, b, at in zip(h["item_slots"], h["doc_slots"], h["places"]):
            seen[a, b].add(at)
    maps = majority_mapping(seen)
    follows = lambda h: h["item_slots"] == h["doc_slots"] or all(maps.get(a) == b for a, b in zip(h["item_slots"], h["doc_slots"]))
    place = lambda h: (h["item_pos"], h["doc_pos"])
    return in_order([place(h) for h in hits]), in_order([place(h) for h in hits if follows(h)]), all(a == b for a, b in seen), all(maps.get(a) == b for a, b in seen)


def best_agreement(hits: list[dict], start: int) -> tuple:
    """Of the spans of shifts that begin at a hit in start .. start + NEAR - 1 that with the largest agreement: shift, matched, agreed, exact, consistent."""
    best = None
    for s in sorted({h["doc_pos"] - h["item_pos"] for h in hits}):
        if s < start + NEAR:
            got = agreement([h for h in hits if s <= h["doc_pos"] - h["item_pos"] <= s + NEAR])
            alone = agreement([h for h in hits if h["doc_pos"] - h["item_pos"] == s])  # not disturbed by its neighbours
            for matched, agreed, exact, consistent in (got, alone):
                key = (agreed, exact, consistent, matched, -s)
                if best is None or key > best[0]:
                    best = key, (s, matched, agreed, exact, consistent)
    return best[1] if best else None


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("hits", "span")]
        found = [best_agreement(h, s * NEAR) for h, s in zip(*columns)]
        has = pa.array([i for i, x in enumerate(found) if x], pa.int64())
        shift, matched, agreed, exact, consistent = zip(*[x for x in found if x]) if len(has) else ((),) * 5
        kept = ["doc_id", "item_id", "reading", "n_windows"]
        yield pa.record_batch(
            [*[batch.column(c).take(has) for c in kept], pa.array(shift, pa.int32()), pa.array(matched, pa.int64()), pa.array(agreed, pa.int64()), pa.array(exact, pa.bool_()), pa.array(consistent, pa.bool_())],
            names=[*kept, "shift", "n_matched", "n_agreed", "exact", "consistent"],
        )


_FOUND = "doc_id long, item_id long, reading int, n_windows long, shift int, n_matched long, n_agreed long, exact boolean, consistent boolean"


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: float = 0.5) -> DataFrame:
    """One row per (doc_id, item_id) with a matching window.

    n_windows of the item, n_matched of them, n_agreed of these under one mapping of
    values, exact (all slot values equal), consistent (all values map one to one),
    contaminated (n_agreed reaches the coverage of the windows).
    """
    spark = docs.sparkSession
    ship(spark)
    items = items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string")).where("id is not null")
    short = list(range(LEAST, width))
    bench = written(items.mapInArrow(lambda b: _windows(b, width, short, None, True), _SCHEMA), "items")
    lengths = [r.w for r in bench.where(F.col("w") < width).select("w").distinct().collect()]  # of short items, fewer than width values
    bits = spark.sparkContext.broadcast(hash_filter(bench, "hash", FILTER_BITS))
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).where("id is not null")
    found = docs.mapInArrow(lambda b: _windows(b, width, lengths, bits.value, False), _SCHEMA)
    found = found.select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "hash", F.col("slots").alias("doc_slots"))
    right = bench.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "hash", "reading", F.col("total").alias("n_windows"), F.col("slots").alias("item_slots"), "places")
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    hits = found.join(right, "hash").withColumn("shift", F.col("doc_pos") - F.col("item_pos"))
    # a span has the shifts of 2 * NEAR, the next begins NEAR on: a group holds at most 2 * NEAR hits for each window of the item
    span = F.floor(F.col("shift") / NEAR).cast("int")
    hits = hits.withColumn("span", F.explode(F.array(span, span - 1)))
    per = hits.groupBy("doc_id", "item_id", "reading", "span").agg(
        F.max("n_windows").cast("long").alias("n_windows"),
        F.collect_set(F.struct("item_pos", "doc_pos", "item_slots", "doc_slots", "places")).alias("hits"),  # repeated rows once, before the exchange
    )
    per = per.mapInArrow(_agreements, _FOUND)
    per = per.withColumn("contaminated", F.col("n_agreed") >= coverage * F.col("n_windows"))
    share = (F.col("n_agreed") / F.col("n_windows")).alias("share")
    best = F.struct("contaminated", share, "exact", "consistent", (-F.col("reading")).alias("r"), "n_matched", (-F.col("shift")).alias("s"), "n_agreed", "n_windows")
    best = per.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", "b.n_matched", "b.n_agreed", "b.exact", "b.consistent", "b.contaminated")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates; rows are told apart by a 64-bit hash of id and text."""
    mark = F.xxhash64("doc_id", "text")
    bad = leaks(docs.select(mark.alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias("_mark")).distinct()
    bad = written(bad, "leaks")
    if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.select(F.struct("*").alias("row"), mark.alias("_mark")).join(bad, "_mark", "left_anti").select("row.*")


def op4_query(spark, sf_dir: str) -> DataFrame:
    """The contaminated pairs of all documents and benchmark items."""
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("contaminated").drop("contaminated")
