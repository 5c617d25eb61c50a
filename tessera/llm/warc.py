"""WARC records and resolution of not-modified revisits.

A revisit record says that a page has not changed; it has headers, but no body.
``resolve`` finds for each revisit the latest earlier full response of the same
canonical URL, checks the validators and gives the body's record id with merged
headers.

The as-of join is a two-level scan, so that one URL with a third of all captures
stays no single task: rows are grouped by (URL, span of time); inside a span the
last response so far comes from a window; the last response of each span, one row
a span, is carried to later spans; both are merged.  Bodies are not shuffled.

Merging: of the revisit's headers only those in ``PERMITTED`` replace or extend
the response's, by lower-case name.  Validators: an ETag on both sides must be equal
(weak comparison, without W/); without one on both, a Last-Modified on both must be
equal; without either, a payload digest on both must be equal; with none the
revisit is resolved as ``unchecked``.

Edge cases: records with null or empty URL resolve with nothing; null times sort
first and precede all; a response at the same time as a revisit counts as earlier
if its record id is smaller; repeated rows are each resolved; null header maps
are empty; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "set-cookie", "vary", "warning", "x-cache")
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid|sid|phpsessionid"
SPAN_SECONDS = 6 * 3600


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment and tracking parameters, host in lower case, no / at the end."""
    host = F.translate(F.regexp_extract(url, r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), rf"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    rest = F.regexp_replace(rest, r"/$", "")
    return F.when(url.contains("://"), F.concat(host, rest))


def header(headers: Column, name: str) -> Column:
    """A header's value by lower-case name."""
    return F.element_at(headers, F.lit(name))


def lower_keys(headers: Column) -> Column:
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    # of names that differ in case only, the last in order counts
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda e: e["key"])), lambda k: F.struct(k, F.element_at(F.filter(F.array_sort(pairs), lambda e: e["key"] == k), -1)["value"])))


def resolve(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """record_id, url_key, ts, response_id, status, headers of every revisit of ``records``.

    records: record_id long, url string, ts timestamp, type ('response' or
    'revisit'), headers map, digest string.  status: ``resolved``, ``unchecked``, ``mismatch`` or ``orphan``; response_id
    and merged headers for the first two, else the revisit's own headers.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "type", lower_keys(F.col("headers")).alias("headers"), "digest")
    r = r.where(F.col("type").isin("response", "revisit"))
    r = r.withColumn("span", F.coalesce(F.floor(F.unix_timestamp("ts") / span_seconds), F.lit(-(1 << 62))))
    facts = F.struct("ts", "record_id", "headers", "digest")
    full = F.when(F.col("type") == "response", facts)
    keyed = r.where("url_key is not null and url_key <> ''")
    inside = Window.partitionBy("url_key", "span").orderBy(F.col("ts").asc_nulls_first(), "record_id", F.desc("type")).rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumn("near", F.last(full, ignorenulls=True).over(inside)).where("type = 'revisit'")
    # the last response of each span: one row a span, then the last of the spans before
    order = F.struct(F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))), "record_id")
    spans = keyed.groupBy("url_key", "span").agg(F.max_by(full, F.when(F.col("type") == "response", order)).alias("latest"))
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("url_key", "span", F.last("latest", ignorenulls=True).over(before).alias("far"))
    found = near.join(spans, ["url_key", "span"], "left").withColumn("of", F.coalesce("near", "far")).drop("near", "far")
    lost = r.where("type = 'revisit' and (url_key is null or url_key = '')")
    found = found.unionByName(lost.withColumn("of", F.lit(None).cast(dict(found.dtypes)["of"])))

    mine, theirs = F.col("headers"), F.col("of.headers")
    strong = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    checks = [(strong(mine), strong(theirs)), (header(mine, "last-modified"), header(theirs, "last-modified")), (F.col("digest"), F.col("of.digest"))]
    status = F.when(F.col("of").isNull(), "orphan")
    for a, b in checks:
        status = status.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("mismatch"))
    found = found.withColumn("status", status.otherwise("unchecked"))
    good = F.col("status").isin("resolved", "unchecked")
    allowed = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return found.select("record_id", "url_key", "ts", F.when(good, F.col("of.record_id")).alias("response_id"), "status", F.when(good, merged).otherwise(mine).alias("headers"))


# ---- files ------------------------------------------------------------------------------------------------------


def write_warc(records: Iterable[dict]) -> bytes:
    """Records (type, url, date, id, headers, body) as a WARC 1.1 file, a gzip member each."""
    out = io.BytesIO()
    for r in records:
        status = "304 Not Modified" if r["type"] == "revisit" else "200 OK"
        http = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r["headers"].items()) + "\r\n"
        block = http.encode("utf-8") + (r.get("body") or b"")
        lines = ["WARC/1.1", f"WARC-Type: {r['type']}", f"WARC-Record-ID: <urn:tessera:{r['id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}"]
        if r["type"] == "revisit":
            lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified")
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        out.write(gzip.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0))
    return out.getvalue()


def read_warc(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, gzipped or plain; reading stops where the file is cut off."""
    stream = io.BytesIO(data)
    source = gzip.GzipFile(fileobj=stream) if data[:2] == b"\x1f\x8b" else stream
    while True:
        try:
            line = source.readline()
            while line in (b"\r\n", b"\n"):
                line = source.readline()
            if not line.startswith(b"WARC/"):
                return
            fields = {}
            while (line := source.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            size = int(fields.get("content-length", 0))
            block = source.read(size)
        except (EOFError, ValueError, OSError):
            return
        if len(block) < size:
            return
        head, _, body = block.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        yield {"type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "id": fields.get("warc-record-id", "").removeprefix("<urn:tessera:").removesuffix(">"), "headers": headers, "body": body}


# ---- the query --------------------------------------------------------------------------------------------------


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made from the pages: each page is a capture in order of page_id, two in five of them revisits.

    Responses have an ETag that changes with every third hundred of page_ids of a site section.
    """
    key = canonical_url(F.col("url"))
    section = F.regexp_extract(key, r"^([^?]*?)(/[0-9]+[^/]*)?$", 1)
    number = F.col("page_id")
    url = F.concat(F.lit("https://www."), section, F.lit("/"), (number % 7).cast("string"), F.lit("?utm_source="), number.cast("string"))
    etag = F.concat(F.lit('"'), F.md5(F.concat(section, F.lit(":"), F.floor(number / 300).cast("string"))), F.lit('"'))
    revisit = number % 5 >= 3
    etag = F.when(revisit & (number % 2 == 0), F.concat(F.lit("W/"), etag)).otherwise(etag)
    empty = F.lit(None).cast("string")
    headers = F.create_map(
        F.lit("ETag"), F.when(number % 11 != 0, etag), F.lit("Date"), number.cast("string"), F.lit("Content-Type"), F.when(revisit, empty).otherwise("text/html"), F.lit("X-Own"), F.when(revisit, "revisit").otherwise("response"),
    )
    headers = F.map_filter(headers, lambda k, v: v.isNotNull())
    return pages.select(
        number.alias("record_id"), url.alias("url"), F.timestamp_seconds(F.lit(1_700_000_000) + number * 60).alias("ts"),
        F.when(revisit, "revisit").otherwise("response").alias("type"), headers.alias("headers"), F.when(~revisit, F.md5("html")).alias("digest"),
    )


def op5_query(spark, sf_dir: str) -> DataFrame:
    """All revisits of the crawl made from the pages, resolved."""
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    listed = F.concat_ws(";", F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "url_key", "response_id", "status", listed.alias("headers"))


_HOST = r"regexp_replace(regexp_replace(translate(regexp_extract(url, '(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '')"
_REST = rf"regexp_replace(regexp_extract(url, '(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1), '([?&])({TRACKING})=[^&]*', '\1', 'g')"
_REST = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_REST}, '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/$', '')"
OP5_SQL = rf"""
WITH k AS (SELECT page_id AS n, regexp_extract({_HOST} || {_REST}, '^([^?]*?)(/[0-9]+[^/]*)?$', 1) AS section FROM pages),
r AS (SELECT n, n % 5 >= 3 AS revisit, regexp_replace(section, '^www\.', '') || '/' || (n % 7) AS url_key,
  CASE WHEN n % 11 <> 0 THEN '"' || md5(section || ':' || floor(n / 300)::BIGINT) || '"' END AS etag FROM k),
j AS (SELECT a.*, (SELECT max(b.n) FROM r b WHERE NOT b.revisit AND b.url_key = a.url_key AND b.n < a.n) AS of FROM r a WHERE a.revisit),
s AS (SELECT j.*, b.etag AS theirs, CASE WHEN of IS NULL THEN 'orphan' WHEN j.etag IS NULL OR b.etag IS NULL THEN 'unchecked' WHEN j.etag = b.etag THEN 'resolved' ELSE 'mismatch' END AS status FROM j LEFT JOIN r b ON b.n = j.of),
h AS (SELECT *, status IN ('resolved', 'unchecked') AS good, CASE WHEN n % 2 = 0 THEN 'W/' || etag ELSE etag END AS own FROM s)
SELECT n AS record_id, url_key, CASE WHEN good THEN of END AS response_id, status,
  concat_ws(';', CASE WHEN good THEN 'content-type=text/html' END, 'date=' || n, 'etag=' || CASE WHEN good THEN coalesce(own, theirs) ELSE own END, 'x-own=' || CASE WHEN good THEN 'response' ELSE 'revisit' END) AS headers
FROM h
"""
