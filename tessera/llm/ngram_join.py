"""N-gram Jaccard join with signature trees.

Documents whose sets of k-word shingles have Jaccard similarity of at least
``num / den`` are linked; the result names each document's component.

1. A sketch with a fixed number of slots counts shingles over all documents.  It
   only orders shingles from rare to frequent; any order gives the same result.
2. Large sets are cut by hash into R classes, R growing with the size: if two sets
   have Jaccard similarity t, their parts in some class have it too.  A set takes
   part with every R from that of its own size to that of the largest partner's, so the two meet.
   Two parts of similarity t share a shingle among the ``n - ceil(t n) + 1`` rarest
   of each (prefix filter).  Equal sets count as one.  A part leaves the bucket of such a
   shingle before its bitmap is sent there, if by sizes and the shingle's places it has
   no partner for which this is the rarest common shingle.  Within each bucket a signature
   tree finds the pairs of parts that their bitmaps and sizes
   allow; connected components of these are candidate groups.
3. A candidate group is ordered by set size and cut into leaves of a bounded
   number of sets and shingles.  A leaf is a node of the signature tree: OR-combined token
   bitmap, size range, fewest bits of a member; ``FAN`` leaves make a node above.  Every leaf
   is verified in itself and against the next one: a task builds the lower levels,
   traverses the trees together, verifies what the bitmaps leave on the whole sets, and
   returns links that span its components.
4. A group of several leaves is cut again, in the order of the components found so
   far.  Dual traversal from the nodes above: pairs of nodes whose largest possible
   overlap is too small, or whose members all lie in one component, are pruned; the leaf
   pairs that remain are verified like those before.
5. Connected components of all links.

Any number of equal or near copies is handled: equal sets collapse before the
shuffle, rows of frequent shingles are dealt by shingle and set, a large group is
split into leaves by ranges, each task holds two leaves at most, and of a group that
step 3 connects step 4 has nothing left to compare.

Edge cases: null, empty or wordless texts have no shingles and link with
nothing; fewer words than k make one shingle of the whole sequence; repeated
rows (even repeated or null doc_ids) each get their row; very long texts are
taken whole, a task holds one beside a MB of others; other columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .shared import connected_components, hash_filter, may_hold, remove, ship, written

SKETCH_BITS = 22
FILTER_BITS = 24
SIGNATURE_WORDS = 16
LEAF, LEAF_SHINGLES, FAN = 512, 1 << 21, 64
BUCKET, HOT, SALTS, SHARDS = 4096, 13, 64, 16
PART = 768


def _shingled(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, data, offsets in A.text_slices(batch.column("text")):
        starts, ends, rows = A.word_spans(data, offsets)
        hashes = A.span_hashes(data, starts, ends, fold=True)
        for r, s in enumerate(A.doc_shingles(hashes, rows, len(offsets) - 1, k)):
            yield row + r, s


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit identity of each set of shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    total = np.zeros(int(sizes.sum()) + 1, np.uint64)
    if sizes.sum():
        np.cumsum(A.mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return A.mix(total[at[1:]] - total[at[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Slots that are frequent among the shingles of this task, with their counts."""
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    for batch in batches:
        for row, data, offsets in A.text_slices(batch.column("text")):
            starts, ends, rows = A.word_spans(data, offsets)
            every = A.window_hashes(A.span_hashes(data, starts, ends, fold=True), k)
            every = every[rows[: len(every)] == rows[k - 1 :][: len(every)]]
            slots, times = np.unique((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
            counts[slots] += times.astype(np.int32)
    slots = np.flatnonzero(counts > 3 + 3 * counts.mean())
    yield pa.record_batch({"slot": pa.array(slots), "cnt": pa.array(counts[slots], pa.int64())})


def classes_of(n: int, num: int, den: int) -> list[int]:
    """The numbers of classes into which a set of n shingles is cut."""
    r, out = 1, []
    while n > r * PART:
        r *= 2
    while True:
        out.append(r)
        if n * den // num <= r * PART:
            return out
        r *= 2


def _parts(s: np.ndarray, weights: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class id, the part's shingles, its rarest shingles as keys, rarest first, how many of these are not frequent) of each part of a set."""
    for r in classes_of(len(s), num, den):
        of = s & np.uint64(r - 1)
        for c in range(r):
            part = s[of == c] if r > 1 else s
            if not len(part):
                continue
            weight = weights[(part >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
            key = (weight << np.uint64(58)) | (part >> np.uint64(6))
            m = len(part) - (num * len(part) + den - 1) // den + 1
            least = np.flatnonzero(key <= np.partition(key, m - 1)[m - 1])  # one order for all sets: by key, then by shingle
            least = least[np.argsort(key[least], kind="stable")][:m]
            yield r + c, part, (part[least] ^ A.mix(np.full(1, r + c, np.uint64))).view(np.int64), int((weight[least] < HOT).sum())


def _keys(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each document's set size and identity; for the first document of a set in this task also its parts.

    cold: how many of the keys, which come first, are not of frequent shingles.
    """
    kind = pa.list_(pa.struct([("part", pa.int32()), ("n", pa.int32()), ("bits", pa.binary()), ("cold", pa.int32()), ("keys", pa.list_(pa.int64()))]))
    seen: set[int] = set()
    for batch in batches:
        sets = [s for _, s in _shingled(batch, k)]
        ids, parts = set_ids(sets), []
        for s, i in zip(sets, ids.tolist()):
            if not len(s) or i in seen:
                parts.append(None)
                continue
            if len(seen) < 1_000_000:
                seen.add(i)
            found = list(_parts(s, weights, num, den))
            bits = signatures([p for _, p, _, _ in found])
            parts.append([{"part": c, "n": len(p), "bits": b.tobytes(), "cold": cold, "keys": keys} for (c, p, keys, cold), b in zip(found, bits)])
        sizes = [len(s) for s in sets]
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "mark": batch.column("mark"),
                "n_shingles": pa.array(sizes, pa.int64()),
                "sid": pa.array([i if n else None for i, n in zip(ids.tolist(), sizes)], pa.int64()),
                "parts": pa.array(parts, kind),
            }
        )


def _candidate_sets(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The whole sets of documents whose identity may be a candidate's, once a task."""
    seen: set[int] = set()
    for batch in batches:
        sets = [s for _, s in _shingled(batch, k) if len(s)]
        ids = set_ids(sets)
        out = []
        for j in np.flatnonzero(may_hold(bits, ids)).tolist():
            i = int(ids[j])
            if i not in seen:
                if len(seen) < 1_000_000:
                    seen.add(i)
                out.append((i, sets[j].tobytes()))
        yield pa.record_batch({"sid": pa.array([i for i, _ in out], pa.int64()), "tokens": pa.array([b for _, b in out], pa.binary())})


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Token bitmaps, one row of 64-bit words a set."""
    bits = np.zeros((len(sets), SIGNATURE_WORDS * 64), bool)
    for i, s in enumerate(sets):
        bits[i, ((s >> np.uint64(12)) & np.uint64(SIGNATURE_WORDS * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


class Node:
    """OR of the members' bitmaps, their size range and the fewest bits of a member; a leaf has the members' numbers."""

    __slots__ = ("bits", "lo", "hi", "least", "parts", "members")

    def __init__(self, bits, lo, hi, least, parts=(), members=None):
        self.bits, self.lo, self.hi, self.least, self.parts, self.members = bits, lo, hi, least, parts, members


def signature_tree(order: np.ndarray, sizes: np.ndarray, bits: np.ndarray, fan: int = 16) -> Node:
    """A tree over the sets numbered in ``order`` (ascending size)."""
    ones = np.bitwise_count(bits).sum(axis=1)
    level = [
        Node(np.bitwise_or.reduce(bits[m]), int(sizes[m].min()), int(sizes[m].max()), int(ones[m].min()), members=m)
        for m in (order[i : i + fan] for i in range(0, len(order), fan))
    ]
    while len(level) > 1:
        level = [
            Node(np.bitwise_or.reduce([x.bits for x in p]), min(x.lo for x in p), max(x.hi for x in p), min(x.least for x in p), p)
            for p in (level[i : i + fan] for i in range(0, len(level), fan))
        ]
    return level[0]


def may_link(a: Node, b: Node, num: int, den: int) -> bool:
    """False if no member of a can reach the similarity with a member of b."""
    if a.hi * den < b.lo * num or b.hi * den < a.lo * num:
        return False
    common = int(np.bitwise_count(a.bits & b.bits).sum())
    most = min(a.hi - max(0, a.least - common), b.hi - max(0, b.least - common))
    return most * (num + den) >= num * (a.lo + b.lo)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    common = overlap(a, b)
    return den * common >= num * (len(a) + len(b) - common)


def spanning_links(sizes: np.ndarray, bits: np.ndarray, split: int | None, num: int, den: int, confirm=None) -> list[tuple[int, int]]:
    """Pairs of set numbers that connect what all pairs together connect which the trees leave over and ``confirm`` accepts.

    split: only pairs of one number below it and one not below; None: all pairs.
    """
    parent = list(range(len(sizes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.argsort(sizes, kind="stable")
    if split is None:
        one = two = signature_tree(order, sizes, bits)
    else:
        one, two = (signature_tree(o, sizes, bits) for o in (order[order < split], order[order >= split]))
    out, stack = [], [(one, two)]
    while stack:
        a, b = stack.pop()
        if not may_link(a, b, num, den):
            continue
        if a.members is None or b.members is None:
            if a is b:
                stack += [(x, y) for i, x in enumerate(a.parts) for y in a.parts[i:]]
            else:
                big, small = (a, b) if a.members is None and (b.members is not None or a.hi - a.lo >= b.hi - b.lo) else (b, a)
                stack += [(x, small) for x in big.parts]
            continue
        n, m = sizes[a.members][:, None], sizes[b.members][None, :]
        p, q = bits[a.members][:, None, :], bits[b.members][None, :, :]
        most = np.minimum(n - np.bitwise_count(p & ~q).sum(axis=2, dtype=np.int64), m - np.bitwise_count(q & ~p).sum(axis=2, dtype=np.int64))
        may = (most * (num + den) >= num * (n + m)) & (n * den >= m * num) & (m * den >= n * num)
        for x, y in zip(*(i.tolist() for i in np.nonzero(np.triu(may, 1) if a is b else may))):
            x, y = int(a.members[x]), int(b.members[y])
            if root(x) != root(y) and (confirm is None or confirm(x, y)):
                parent[root(x)] = root(y)
                out.append((x, y))
    return out


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of each key, which come one key after the other, as tuples of ``columns``."""
    key, rows = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in by))
        for k, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in columns))):
            if k != key:
                if rows:
                    yield rows
                key, rows = k, []
            rows.append(row)
    if rows:
        yield rows


def _links(found: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for links in found:
        out += links
        if len(out) >= 10_000:
            yield pa.record_batch({"x": pa.array([a for a, _ in out], pa.int64()), "y": pa.array([b for _, b in out], pa.int64())})
            out = []
    yield pa.record_batch({"x": pa.array([a for a, _ in out], pa.int64()), "y": pa.array([b for _, b in out], pa.int64())})


def _plausible(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Spanning pairs of each bucket by bitmaps and sizes alone."""

    def found():
        for rows in _runs(batches, ["key"], ["sid", "n", "bits"]):
            ids = [r[0] for r in rows]
            bits = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), -1)
            yield [(ids[x], ids[y]) for x, y in spanning_links(np.array([r[1] for r in rows]), bits, None, num, den)]

    return _links(found())


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each task (grp, i, j), verified on the whole sets."""

    def found():
        for rows in _runs(batches, ["grp", "i", "j"], ["side", "sid", "tokens"]):
            rows.sort(key=lambda r: r[0])
            ids, sets = [r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows]
            left = sum(r[0] == 0 for r in rows)
            split = left if left < len(rows) else None
            pairs = spanning_links(np.array([len(t) for t in sets]), signatures(sets), split, num, den, lambda x, y: linked(sets[x], sets[y], num, den))
            yield [(ids[x], ids[y]) for x, y in pairs]

    return _links(found())


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmap and number of bits of each set."""
    for batch in batches:
        bits = signatures([np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()])
        yield pa.record_batch({"sid": batch.column("sid"), "bits": pa.array(bits.view(np.int64).tolist(), pa.list_(pa.int64())), "ones": pa.array(np.bitwise_count(bits).sum(axis=1).astype(np.int64))})


def _with_company(keys: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, part, key, salt) of the rows (sid, part, n, at, key, salt) that may have a partner in their bucket (key, salt).

    at: how many rarer shingles the part has.  If a bucket's shingle is the rarest that two parts of n and m share, they share
    n - at at most, so m is between n * num / den and ``most``, and the same holds from the other side.  Rows of salted
    shingles stay, as their bucket is dealt to several tasks.  Copies of a row may come out twice.
    """
    bucket = Window.partitionBy("key", "salt").orderBy("n", "sid")
    rows = keys.withColumn("most", F.expr(f"(cast(n - at as long) * {num + den}) div {num} - n"))
    rows = rows.select("sid", "part", "key", "salt", "n", "most", *[f(c).over(bucket).alias(f"{name}_{c}") for f, name in ((F.lag, "before"), (F.lead, "after")) for c in ("sid", "n")],
                       F.max("most").over(bucket.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"))
    # copies of a row lie side by side: the first looks back, the last ahead
    first, last = F.expr("before_sid is null or before_sid <> sid"), F.expr("after_sid is not null and after_sid <> sid")
    smaller = F.expr(f"cast(before_n as long) * {den} >= cast(n as long) * {num} and reach >= n")
    return rows.where(first & ((F.col("salt") > 0) | smaller) | last & F.expr("after_n <= most")).select("sid", "part", "key", "salt")


def _leaves(sets: DataFrame, leaf: int) -> DataFrame:
    """(grp, leaf, sid, n, comp): leaves of sets (grp, sid, n, comp, sub) in the order of (sub, n).

    A leaf has at most ``leaf`` sets and about ``LEAF_SHINGLES`` shingles.  Places are sums within (grp, sub, n, shard) plus
    those of the cells before, so no task orders a whole group.
    """
    s = sets.withColumn("cost", F.greatest(F.lit(1), F.floor(F.col("n") * leaf / LEAF_SHINGLES)).cast("long")).withColumn("shard", F.shiftrightunsigned(F.xxhash64("sid"), 64 - SHARDS.bit_length() + 1))
    cell = ["grp", "sub", "n", "shard"]
    cells = s.groupBy(*cell).agg(F.sum("cost").alias("all"))
    up = Window.partitionBy("grp").orderBy("sub", "n", "shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.coalesce(F.sum("all").over(up), F.lit(0)).alias("first"))
    own = Window.partitionBy(*cell).orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("own", F.coalesce(F.sum("cost").over(own), F.lit(0))).join(cells, cell)
    return s.select("grp", F.floor((F.col("first") + F.col("own")) / leaf).cast("int").alias("leaf"), "sid", "n", "comp")


def _leaf_pairs(leaves: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(grp, i, j) for leaves i <= j of one group that may hold links between components: upper levels of the dual traversal."""
    bits = leaves.select("sid").distinct().join(sets, "sid").select("sid", "tokens").mapInArrow(_nodes, "sid long, bits array<long>, ones long")
    words = [f"w{w}" for w in range(SIGNATURE_WORDS)]
    ored = [F.bit_or(F.col("bits")[w]).alias(f"w{w}") for w in range(SIGNATURE_WORDS)]
    size = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("ones").alias("least"), F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi")]
    nodes = written(leaves.join(bits, "sid").groupBy("grp", "leaf").agg(*size, *ored), "leaves").withColumn("up", F.floor(F.col("leaf") / FAN).cast("int"))
    size = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least"), F.min("c_lo").alias("c_lo"), F.max("c_hi").alias("c_hi")]
    above = nodes.groupBy("grp", F.col("up").alias("leaf")).agg(*size, *[F.bit_or(w).alias(w) for w in words])

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("grp", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != "grp"])

    common = sum((F.bit_count(F.col(f"a_{w}").bitwiseAND(F.col(f"b_{w}"))) for w in words), F.lit(0))
    most = F.least(*[F.col(f"{s}_hi") - F.greatest(F.lit(0), F.col(f"{s}_least") - common) for s in "ab"])
    near = F.expr(f"a_hi * {den} >= b_lo * {num} and b_hi * {den} >= a_lo * {num}") & (most * (num + den) >= num * (F.col("a_lo") + F.col("b_lo")))
    may = F.expr("a_leaf <= b_leaf and not (a_c_lo = a_c_hi and b_c_lo = b_c_hi and a_c_lo = b_c_lo)") & near
    pairs = side(above, "a").join(side(above, "b"), "grp").where(may).select("grp", F.col("a_leaf").alias("a_up"), F.col("b_leaf").alias("b_up"))
    pairs = pairs.join(side(nodes, "a"), ["grp", "a_up"]).join(side(nodes, "b"), ["grp", "b_up"]).where(may)
    return pairs.select("grp", F.col("a_leaf").alias("i"), F.col("b_leaf").alias("j"))


def _verified(leaves: DataFrame, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (x, y) within and between the leaves of each pair (grp, i, j), i <= j."""
    within = pairs.where("i = j").join(leaves.withColumnRenamed("leaf", "i"), ["grp", "i"]).select("grp", "i", "j", F.lit(0).alias("side"), "sid")
    tasks = within
    for side, end in enumerate("ij"):
        tasks = tasks.union(pairs.where("i < j").join(leaves.withColumnRenamed("leaf", end), ["grp", end]).select("grp", "i", "j", F.lit(side).alias("side"), "sid"))
    tasks = tasks.join(sets, "sid").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "sid").select("grp", "i", "j", "side", "sid", "tokens")
    return written(tasks.mapInArrow(lambda b: _verify(b, num, den), "x long, y long"), "links")


def _components(docs: DataFrame, k: int, num: int, den: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_shingles, sid) of every row of ``docs`` (doc_id, mark, text), and (sid, least) of sets with company.

    least: (doc_id, mark) of the component's first row.
    """
    spark = docs.sparkSession
    ship(spark)
    text = docs.select("text")

    sketch = text.mapInArrow(lambda b: _sketch(b, k), "slot long, cnt long").groupBy("slot").agg(F.sum("cnt").alias("cnt"))
    weights = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in sketch.toLocalIterator():  # at most 2 ** SKETCH_BITS rows at any size
        weights[r.slot] = min(63, int(r.cnt).bit_length())
    shared = spark.sparkContext.broadcast(weights)
    found = written(docs.select("doc_id", "mark", "text").mapInArrow(lambda b: _keys(b, k, num, den, shared.value), "doc_id long, mark long, n_shingles long, sid long, parts array<struct<part:int,n:int,bits:binary,cold:int,keys:array<long>>>"), "sets")
    shared.destroy()

    parts = found.where("parts is not null").select("sid", "n_shingles", F.explode("parts").alias("p")).select("sid", "n_shingles", "p.*")
    keys = parts.select("sid", "part", "n", "cold", F.posexplode("keys").alias("at", "key"))
    # a frequent shingle's rows are dealt by set too; it only has to be frequent in the sketch for that
    salt = F.when(F.col("at") >= F.col("cold"), F.pmod(F.col("sid"), F.lit(SALTS)) + 1).otherwise(0)
    kept = written(_with_company(keys.select("sid", "part", "n", "at", "key", salt.cast("int").alias("salt")), num, den), "pairs")
    pairs = kept.repartition("key", "salt").dropDuplicates(["key", "salt", "sid"])
    mark = F.xxhash64("sid", "part")
    # of shingles that are not salted the whole bucket lies in one task: those of one set go before the next exchange
    buckets = pairs.groupBy("key", "salt").agg(F.count("*").alias("cnt"), F.bit_xor(mark).alias("h1"), F.bit_xor(F.xxhash64(mark, F.lit(7))).alias("h2"), F.min("sid").alias("least"))
    buckets = buckets.where("cnt >= 2 or salt > 0").groupBy("key").agg(F.sum("cnt").alias("cnt"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.max("salt").alias("salt"), F.min("least").alias("least"))
    buckets = buckets.where("cnt >= 2").groupBy("cnt", "h1", "h2").agg(F.min(F.struct("key", "salt", "least")).alias("b")).select("cnt", "b.*")
    # a bucket too large for one task is a group as it stands: its members with the least of them
    star = F.when(F.col("cnt") > BUCKET, F.col("least")).alias("star")
    spread = F.explode(F.when(F.col("salt") > 0, F.sequence(F.lit(0), F.lit(SALTS))).otherwise(F.array(F.lit(0)))).alias("salt")
    buckets = buckets.select("key", star, spread)
    members = written(pairs.join(buckets.hint("shuffle_hash"), ["key", "salt"]).select("key", "sid", "part", "star"), "members")
    stars = members.where("star is not null").select(F.col("sid").alias("x"), F.col("star").alias("y"))
    once = parts.groupBy("sid", "part").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    small = members.where("star is null").join(once, ["sid", "part"])
    small = small.repartition("key").sortWithinPartitions("key", "sid").select("key", "sid", "n", "bits")
    groups = connected_components(small.mapInArrow(lambda b: _plausible(b, num, den), "x long, y long").union(stars), "x", "y")
    sizes = parts.groupBy("sid").agg(F.max("n_shingles").alias("n"))
    groups = groups.withColumnRenamed("node", "sid").join(sizes, "sid").select(F.col("label").alias("grp"), "sid", "n", F.col("sid").alias("comp"), F.lit(0).cast("long").alias("sub"))
    leaves = written(_leaves(groups, leaf), "groups")
    remove(spark, kept, members)

    filter_ = spark.sparkContext.broadcast(hash_filter(leaves, "sid", FILTER_BITS))
    sets = text.mapInArrow(lambda b: _candidate_sets(b, k, filter_.value), "sid long, tokens binary")
    sets = written(sets.join(leaves.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.max("tokens").alias("tokens")), "tokens")
    filter_.destroy()

    each = leaves.select("grp", F.col("leaf").alias("i")).distinct()
    pairs = each.withColumn("j", F.col("i")).union(leaves.where("leaf > 0").select("grp", (F.col("leaf") - 1).alias("i"), F.col("leaf").alias("j")).distinct().join(each, ["grp", "i"], "left_semi").select("grp", "i", "j"))
    links = _verified(leaves, pairs, sets, num, den)
    labels = connected_components(links, "x", "y").withColumnRenamed("node", "sid")
    large = leaves.where("leaf > 0").select("grp").distinct()
    if large.limit(1).count():
        again = leaves.join(large, "grp", "left_semi").select("grp", "sid", "n").join(labels, "sid", "left").withColumn("comp", F.coalesce("label", "sid"))
        weight = again.groupBy("comp").agg(F.count("*").alias("_w"))
        again = again.join(weight, "comp").withColumn("sub", F.when(F.col("_w") >= leaf, F.col("comp")).otherwise(F.lit(0)))
        again = written(_leaves(again, leaf), "groups")
        more = _verified(again, _leaf_pairs(again, sets, num, den), sets, num, den)
        labels = connected_components(links.union(more), "x", "y").withColumnRenamed("node", "sid")
        remove(spark, again, more)
    remove(spark, leaves, sets, links)

    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least")
    least = found.where("sid is not null").groupBy("sid").agg(least, F.count("*").alias("copies"))
    classes = labels.join(least, "sid", "full").select("sid", "label", "least", "copies")
    of_label = classes.where("label is not null").groupBy("label").agg(F.min("least").alias("component"))
    classes = classes.where("label is not null or copies > 1").join(of_label, "label", "left").select("sid", F.coalesce("component", "least").alias("least"))
    return found.select("doc_id", "mark", "n_shingles", "sid"), classes


def ngram_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); see the module."""
    found, classes = _components(docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("mark"), F.col("text").cast("string")), k, num, den, leaf)
    return found.join(classes, "sid", "left").select("doc_id", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, by doc_id, then by a hash of the text; of rows with one doc_id and text one.

    Rows with null doc_id stay, as do rows without words (repeated ones once).
    """
    mark = F.xxhash64("text")
    found, classes = _components(docs.select(F.col("doc_id").cast("long"), mark.alias("mark"), F.col("text").cast("string")), k, num, den, LEAF)
    later = found.where("doc_id is not null").join(classes, "sid").where("doc_id <> least.doc_id or mark <> least.mark")
    out = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"))
    out = out.join(later.select("doc_id", "mark").distinct(), ["doc_id", "mark"], "left_anti")
    # partitioned by both already
    again = Window.partitionBy("doc_id", "mark").orderBy(F.lit(0))
    return out.withColumn("again", F.row_number().over(again)).where("again = 1 or doc_id is null").select("row.*")


def op6_query(spark, sf_dir: str) -> DataFrame:
    """Components of documents at 3-word shingles and a similarity of 0.9."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=9, den=10)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.m)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) r USING (doc_id)
"""
