"""URL filter: rules by host and path, then a weighted vocabulary.

Rules are tried first, the longest that fits decides.  Other URLs are searched by
an Aho-Corasick automaton for strict and soft terms; percent-encoded ASCII is decoded
first, and a hit counts if no letter or digit stands next to it.  One strict hit rejects, as do
``least`` distinct soft terms or more whose weights reach ``soft_limit`` together.

The vocabulary is a table (term, kind, weight) of at most ``MAX_TERMS`` rows, checked when it is
read, or lists of terms of weight 1.

Edge cases: null URLs and URLs without ``://`` have an empty host and path, no
rule fits them; a null URL has no terms; very long URLs are searched whole, a task holds one batch;
empty and null terms are ignored, of a repeated term strict goes before soft and the largest weight counts; an empty
vocabulary rejects nothing; an empty table gives an empty result; repeated rows each get their row; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
STRICT = ["casino", "porn", "xxx", "viagra", "cialis", "escort", "spam", "adult", "malware", "warez"]
SOFT = ["cheap", "pills", "free", "bets", "bet", "win", "ads", "track", "farm", "poker", "loan", "bonus", "sex", "deal", "click", "casinos"]
MAX_TERMS = 1_000_000
_ESCAPE = re.compile("%([0-7][0-9A-Fa-f])")
_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def fold(c: Column) -> Column:
    """A-Z as a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary_of(strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT) -> list[tuple[str, str, float]]:
    return [(x, "soft", 1.0) for x in soft] + [(x, "strict", 1.0) for x in strict]


def read_vocabulary(table: DataFrame) -> list[tuple[str, str, float]]:
    """The rows of a table (term, kind, weight); ValueError for more than ``MAX_TERMS``."""
    rows = table.select("term", "kind", F.col("weight").cast("double")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return [tuple(r) for r in rows]


def count_terms(batches: Iterator[pa.RecordBatch], vocabulary: list[tuple[str, str, float]]) -> Iterator[pa.RecordBatch]:
    """Adds n_strict (hits), n_soft (distinct terms) and their weight."""
    import ahocorasick

    words: dict[str, tuple[bool, float]] = {}
    for term, kind, weight in vocabulary:
        if term:
            term = term.translate(_LOWER)
            words[term] = max(words.get(term, (False, 0.0)), (kind == "strict", weight or 0.0))
    machine = ahocorasick.Automaton()
    for term, (is_strict, weight) in words.items():
        machine.add_word(term, (term, is_strict))
    machine.make_automaton()
    for batch in batches:
        n_strict, n_soft, weights = [], [], []
        for url in batch.column("url").to_pylist():
            text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), url or "").translate(_LOWER)
            hits, terms = 0, set()
            for last, (term, is_strict) in machine.iter(text) if words else ():
                before, after = text[last - len(term) : last - len(term) + 1] if last >= len(term) else "", text[last + 1 : last + 2]
                if before.isalnum() or after.isalnum():
                    continue
                hits += is_strict
                if not is_strict:
                    terms.add(term)
            n_strict.append(hits)
            n_soft.append(len(terms))
            weights.append(sum(words[x][1] for x in sorted(terms)))
        yield pa.record_batch([*batch.columns, pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64()), pa.array(weights, pa.float64())], names=[*batch.schema.names, "n_strict", "n_soft", "soft_weight"])


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: DataFrame | list | None = None, soft_limit: float = 2.0, least: int = 2) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight of every row of ``pages`` (page_id, url)."""
    ship(pages.sparkSession)
    words = vocabulary_of() if vocabulary is None else vocabulary if isinstance(vocabulary, list) else read_vocabulary(vocabulary)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    found = pages.mapInArrow(lambda b: count_terms(b, words), "page_id long, url string, n_strict long, n_soft long, soft_weight double")
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    found = found.withColumn("host", fold(F.regexp_extract(url, pattern, 1))).withColumn("path", F.regexp_extract(url, pattern, 2))
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for host, path, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = rule.when(fits, host + path), verdict.when(fits, says)
    method = F.when((F.col("n_strict") >= 1) | ((F.col("n_soft") >= least) & (F.col("soft_weight") >= soft_limit)), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.otherwise(method).alias("verdict"), "n_strict", "n_soft", "soft_weight")


def op8_query(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_EDGE = r"(?:^|[^\p{L}\p{N}])", r"(?:$|[^\p{L}\p{N}])"
_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECODE = "array_to_string(list_transform(regexp_extract_all(coalesce(url, ''), '(?s)%[0-7][0-9A-Fa-f]|.'), lambda x: CASE WHEN length(x) = 3 THEN url_decode(x) ELSE x END), '')"
# neighbouring hits share an edge character: doubling the separators keeps each hit's own
_SPREAD = rf"regexp_replace({_FOLD.format(_DECODE)}, '([^\p{{L}}\p{{N}}])', '\1\1', 'g')"
OP8_SQL = rf"""
WITH p AS (
  SELECT page_id, {_SPREAD} AS u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
c AS (
  SELECT *, len(regexp_extract_all(u, '{_EDGE[0]}(?:{"|".join(STRICT)}){_EDGE[1]}'))::BIGINT AS n_strict,
    ({" + ".join(f"regexp_matches(u, '{_EDGE[0]}{t}{_EDGE[1]}')::BIGINT" for t in SOFT)})::BIGINT AS n_soft
  FROM p),
r AS (
  SELECT *, CASE {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule
  FROM c)
SELECT page_id, host, path, rule, n_strict, n_soft, n_soft::DOUBLE AS soft_weight,
  CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)} WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
