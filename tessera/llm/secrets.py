"""Secret scan with multipart credential linking.

Strong kinds are reported by themselves: ``assign`` (a named secret with its
value), ``access`` (an access key id) and ``hex`` (a long hexadecimal run).  Weak
kinds are not: ``endpoint`` (a URL or database address), ``user`` (a named
account) and ``mixed`` (a long run of upper and lower case letters and
digits).  Spans of a document are joined by overlapping intervals: a weak span is
reported if, within ``SCOPE`` code points, there is a complementary part: for
``endpoint`` and ``user`` a secret (strong, or ``mixed``), for ``mixed`` an
``access``, ``endpoint`` or ``user``.  Each link is reported with both its parts.

DataFrame and SQL functions only.  Texts are scanned once and not shuffled; the
interval join deals spans to bins of ``SCOPE`` code points, so one document with
many spans is many tasks, and only documents with a weak span enter it.

Edge cases: null and empty texts have no spans; spans count code points, end exclusive; equal
texts, repeated rows and null doc_ids are told apart by a row number of the
scan written to the shared folder; very long texts are scanned whole, spans of one text are an array of its row;
spans of two kinds at one place are both reported; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SCOPE = 200
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"  # of maximal runs, those of 20+ and 24+ characters
ENDPOINT = r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[A-Za-z0-9._~:/?@=&%+-]+"
USER = r"(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_[iI][dD]|[aA][cC][cC][oO][uU][nN][tT])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}"
MIXED = r"[A-Za-z0-9+/]{32,}"
STRONG, WEAK = ("assign", "access", "hex"), ("endpoint", "user", "mixed")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: an expression inside a lambda is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(lengths: Column) -> Column:
    """For each of an array of integers the sum of those before it.

    Chunks of about the cube root of the number: sums within chunks, then of chunks, so lists that grow stay short.
    """
    size = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(lengths)))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")), lambda c: F.slice(lengths, c * size + 1, size))

    def running(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def joined(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), running(totals, F.lit(0)).alias("start")), lambda z: running(z["chunk"], z["start"])))

    return let(chunks, joined)


def spans(text: Column, pattern: str, group: int | None = None, least: int = 0, test: Callable[[Column], Column] | None = None) -> Column:
    """(start, end) of the leftmost matches that don't overlap, in code points; those whose ``group`` has ``least`` characters and that pass the test.

    The text is split at the matches; the lengths of pieces and matches add up to places.
    """

    def placed(found: Column) -> Column:
        good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least) if group else F.transform(found, test or (lambda x: F.lit(True)))
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
        return let(F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("len"), good.alias("good")), summed)

    def summed(rows: Column) -> Column:
        before = let(F.transform(rows, lambda r: r["gap"] + r["len"]), _before)
        every = F.zip_with(rows, before, lambda r, b: F.when(r["good"], F.struct((b + r["gap"]).alias("start"), (b + r["gap"] + r["len"]).alias("end"))))
        return F.array_compact(every)

    nothing = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(nothing)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row, and the spans of each kind of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return d.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        spans(F.col("text"), ASSIGN, 1, 6).alias("assign"),
        spans(F.col("text"), ACCESS).alias("access"),
        spans(F.col("text"), HEX).alias("hex"),
        spans(F.col("text"), ENDPOINT).alias("endpoint"),
        spans(F.col("text"), USER).alias("user"),
        spans(F.col("text"), MIXED, test=lambda x: x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]")).alias("mixed"),
    )


def tagged(kinds: tuple[str, ...]) -> Column:
    """All spans of these kinds as (start, order, end, kind), sorted by start, then kind as listed."""
    every = [*STRONG, *WEAK]

    def one(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(every.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[one(k) for k in kinds]))


def listed(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


_SPAN = "struct<start:int,order:int,end:int,kind:string>"


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, linked, links): the weak spans of each row that a complementary part supports, and (span, part) for each such part."""
    weak = F.size("endpoint") + F.size("user") + F.size("mixed") > 0
    s = scanned.where(weak).select("row", F.explode(tagged((*STRONG, *WEAK))).alias("s")).select("row", "s.*")
    bins = lambda more: F.explode(F.sequence(F.floor((F.col("start") - more) / scope), F.floor((F.col("end") + more) / scope)))
    a = s.where(F.col("kind").isin(*WEAK)).withColumn("bin", bins(scope))
    b = s.withColumn("bin", bins(0)).select("row", "bin", F.col("start").alias("b_start"), F.col("order").alias("b_order"), F.col("end").alias("b_end"), F.col("kind").alias("b_kind"))
    parts = F.when(F.col("kind") == "mixed", F.col("b_kind").isin("access", "endpoint", "user")).otherwise(F.col("b_kind").isin(*STRONG, "mixed"))
    apart = (F.col("b_end") <= F.col("start")) | (F.col("end") <= F.col("b_start"))
    near = (F.col("b_start") < F.col("end") + scope) & (F.col("start") < F.col("b_end") + scope)
    part = F.struct(F.col("b_start").alias("start"), F.col("b_order").alias("order"), F.col("b_end").alias("end"), F.col("b_kind").alias("kind"))
    found = a.join(b, ["row", "bin"]).where(parts & near & apart).select("row", F.struct("start", "order", "end", "kind").alias("span"), part.alias("part"))
    return found.groupBy("row").agg(F.collect_set("span").alias("linked"), F.array_sort(F.collect_set(F.struct("span", "part"))).alias("links"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, strong spans (base), all spans (found: strong and linked weak ones), and each weak span with each part that supports it (links), of every row."""
    scanned = written(scan(docs), "spans")
    out = scanned.join(link(scanned), "row", "left")
    base = tagged(STRONG)
    none, no_links = F.array().cast(f"array<{_SPAN}>"), F.array().cast(f"array<struct<span:{_SPAN},part:{_SPAN}>>")
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in STRONG], base.alias("base"), F.array_sort(F.concat(base, F.coalesce("linked", none))).alias("found"), F.coalesce("links", no_links).alias("links"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.concat_ws(",", F.transform("links", lambda x: F.concat_ws("+", *[F.concat_ws(":", x[s]["kind"], x[s]["start"], x[s]["end"]) for s in ("span", "part")]))).alias("links"))


def _spans_sql(kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, {[*STRONG, *WEAK].index(kind)} AS o, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x)))"
        f" + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'l': length(m[i]), 'v': length(v[i]), 't': m[i]}}), lambda x: x.v >= {least})) AS r"
        f" FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))"
    )


_KINDS = [("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0), ("endpoint", ENDPOINT, 0, 0), ("user", USER, 0, 0), ("mixed", MIXED, 0, 0)]
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS ({" UNION ALL ".join(_spans_sql(*k) for k in _KINDS)}),
s AS (SELECT doc_id, o, kind, r.s::BIGINT AS s, (r.s + r.l)::BIGINT AS e FROM u
  WHERE kind <> 'mixed' OR (regexp_matches(r.t, '[A-Z]') AND regexp_matches(r.t, '[a-z]') AND regexp_matches(r.t, '[0-9]'))),
p AS (SELECT DISTINCT a.doc_id, a.o, a.kind, a.s, a.e, b.o AS po, b.kind AS pk, b.s AS ps, b.e AS pe FROM s a JOIN s b USING (doc_id)
  WHERE a.o >= 3 AND CASE a.kind WHEN 'mixed' THEN b.kind IN ('access', 'endpoint', 'user') ELSE b.kind IN ('assign', 'access', 'hex', 'mixed') END
    AND (b.e <= a.s OR a.e <= b.s) AND b.s < a.e + {SCOPE} AND a.s < b.e + {SCOPE}),
w AS (SELECT DISTINCT doc_id, o, kind, s, e FROM p),
l AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e || '+' || pk || ':' || ps || ':' || pe, ',' ORDER BY s, o, e, ps, po, pe) AS links FROM p GROUP BY doc_id),
f AS (SELECT * FROM s WHERE o < 3 UNION ALL SELECT doc_id, o, kind, s, e FROM w),
g AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)
"""
