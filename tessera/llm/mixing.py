"""Mixing sources to target weights by iterative proportional fitting.

Documents are aggregated to cells of (source, language, topic).  The token weights of
the cells are raked: each margin in turn is scaled to its target shares until none
is off by more than ``TOLERANCE``, or the error stops falling, which is logged.  A document is then sampled with
probability ``min(1, c * weight / tokens)`` of its cell; c is chosen so that the
expected tokens are the budget.  The coin of a document is a hash of its id and
text, so a sample is the same at every run and in every partitioning.

DataFrame and SQL functions only.  Documents are shuffled once, as partial sums of
cells; the cell table, one row a cell however many documents there are, is joined
back to the documents.

Edge cases: nulls in source, lang or topic are a category of their own (shown as
null); texts without words weigh nothing and are drawn like their cell; categories
without tokens keep weight 0, and targets of categories that don't occur are spread over the
others; one category on a margin leaves it as it is; repeated rows share id and
text and so their coin; an empty table gives an empty result; other columns come
back inside the row, so their names cannot clash.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

MARGINS = ("source", "lang", "topic")
ROUNDS, BUDGET, POWER, BROADCAST_CELLS = 15, 0.6, 0.7, 100_000
BLOCK, TOLERANCE = 15, 1e-6


def words(text: Column) -> Column:
    """Number of words; a word is a run without \\x20 \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """What kind of text it is, by its marks and length."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("Licensed under") | text.contains("is licensed under"), "license")
        .when(text.contains("###") | text.contains("$$$") | text.contains("!!"), "noise")
        .when(F.length(text) < 400, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("long")
    )


def coin(*columns: Column) -> Column:
    """Uniform in [0, 1) by md5 of the columns."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rake(cells: DataFrame, margins: tuple[str, ...] = MARGINS, power: float = POWER, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (margins, tokens) with ``weight``: shares that sum to 1 and meet the targets.

    ``rounds`` at least; then blocks of rounds until the margins are within ``TOLERANCE``
    or a block takes less than a tenth off the error.  An error that remains is logged.

    targets: for a margin (margin, share); without one, shares are proportional to
    tokens ** power of its categories.
    """
    everything = Window.partitionBy()
    out = cells.withColumn("weight", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(everything)), F.lit(0.0)))
    for m in margins:
        if targets and m in targets:
            goal = targets[m].select(F.col(m).alias("_key"), F.col("share").cast("double").alias("_share"))
            out = out.join(F.broadcast(goal), F.col(m).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(f"_t_{m}", F.coalesce("_share", F.lit(0.0))).drop("_share")
        else:
            out = out.withColumn(f"_t_{m}", F.pow(F.sum("tokens").over(Window.partitionBy(m)).cast("double"), F.lit(power)))
        # each category once, those with tokens only
        first = (F.row_number().over(Window.partitionBy(m).orderBy(F.desc("tokens"), *margins)) == 1) & (F.sum("tokens").over(Window.partitionBy(m)) > 0)
        out = out.withColumn("_once", F.when(first, F.col(f"_t_{m}")).otherwise(0.0))
        out = out.withColumn(f"_t_{m}", F.coalesce(F.try_divide(F.col(f"_t_{m}"), F.sum("_once").over(everything)), F.lit(0.0))).drop("_once")
    out = _rounds(out, margins, rounds)
    error = margin_error(out, margins)
    while error > TOLERANCE:
        more = _rounds(out, margins, BLOCK)
        was, error, out = error, margin_error(more, margins), more
        if error > 0.9 * was:
            break
    if error > TOLERANCE:
        logging.getLogger(__name__).warning("margins are off by up to %.2g after raking", error)
    return out


def _rounds(out: DataFrame, margins: tuple[str, ...], rounds: int) -> DataFrame:
    for i in range(rounds):
        for m in margins:
            have = F.sum("weight").over(Window.partitionBy(m))
            out = out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_t_{m}"), have), F.lit(0.0)))
        if i % 5 == 4:  # a short lineage, and a plan that stays small
            out = written(out, "cells")
    return out


def margin_error(raked: DataFrame, margins: tuple[str, ...] = MARGINS) -> float:
    """The largest difference of a raked margin from its target."""
    errors = [raked.groupBy(m).agg(F.abs(F.sum("weight") - F.max(f"_t_{m}")).alias("e")).where(F.col("e").isNotNull()) for m in margins]
    out = errors[0].select("e")
    for e in errors[1:]:
        out = out.union(e.select("e"))
    return out.agg(F.max("e")).first()[0] or 0.0


def probabilities(raked: DataFrame, budget: float) -> DataFrame:
    """``p`` of each cell: min(1, c * weight / tokens), with c so that the expected tokens are ``budget`` of all.

    Cells in descending order of weight / tokens: the first k have p = 1 for the
    least k that leaves the next one at most 1.
    """
    ratio = F.coalesce(F.try_divide("weight", "tokens"), F.lit(0.0))
    cells = raked.withColumn("_r", ratio)
    order = Window.orderBy(F.desc("_r"), *[F.col(c) for c in raked.columns if c in MARGINS])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(budget) * F.sum("tokens").over(Window.partitionBy()) - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    cells = cells.withColumn("_c", F.try_divide(left, F.sum("weight").over(after)))
    # with the cells before it at 1, does this one fit below 1?
    fits = F.col("_c") * F.col("_r") <= 1
    scale = F.max_by("_c", F.when(fits, F.col("_r"))).over(Window.partitionBy())
    return cells.withColumn("p", F.least(F.lit(1.0), F.coalesce(scale, F.lit(1.0)) * F.col("_r"))).drop("_r", "_c")


def sample(docs: DataFrame, budget: float = BUDGET, margins: tuple[str, ...] = MARGINS, power: float = POWER, targets=None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(row, topic, n_tokens, probability, kept) of every document, row being the whole input row; and the cell table."""
    docs = docs.select(F.struct("*").alias("row"), "source", "lang", topic(F.col("text")).alias("topic"), words(F.col("text")).alias("n_tokens"), coin(F.col("doc_id"), F.col("text")).alias("u"))
    cells = docs.groupBy("source", "lang", "topic").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    cells = written(cells, "cells")
    cells = written(probabilities(rake(cells, margins, power, targets, rounds), budget), "mixture")
    key = cells.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), F.col("p").alias("probability"))
    if key.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        key = F.broadcast(key)
    match = F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")) & (F.col("topic") == F.col("_t"))
    out = docs.join(key, match, "left").withColumn("kept", F.col("u") < F.col("probability"))
    return out.select("row", "topic", "n_tokens", "probability", "kept"), cells


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Every document with its cell, probability and whether it is drawn."""
    drawn, _ = sample(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return drawn.select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def _rounds_sql() -> tuple[str, str]:
    """The raking rounds as common table expressions."""
    out, last = [], "w0"
    for i in range(ROUNDS):
        for m in MARGINS:
            name = f"w{i}_{m}"
            out.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0 THEN weight * t_{m} / sum(weight) OVER (PARTITION BY {m}) ELSE 0 END AS weight) FROM {last})")
            last = name
    return ",\n".join(out), last


_ROUNDS, _LAST = _rounds_sql()
_SHARE = "power(sum(tokens) OVER (PARTITION BY {0}), 0.7) / (SELECT sum(power(s, 0.7)) FROM (SELECT sum(tokens) AS s FROM cells GROUP BY {0}) WHERE s > 0) AS t_{0}"
OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, lang, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'Licensed under') OR contains(text, 'is licensed under') THEN 'license'
      WHEN contains(text, '###') OR contains(text, '$$$') OR contains(text, '!!') THEN 'noise'
      WHEN length(coalesce(text, '')) < 400 THEN 'note' WHEN length(text) < 4000 THEN 'article' ELSE 'long' END AS topic,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || coalesce(text, chr(0))), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
w0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM cells) AS weight, {", ".join(_SHARE.format(m) for m in MARGINS)} FROM cells),
{_ROUNDS},
r AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS r FROM {_LAST}),
c AS (SELECT *, ({BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM r WINDOW o AS (ORDER BY r DESC, source NULLS FIRST, lang NULLS FIRST, topic NULLS FIRST)),
p AS (SELECT source, lang, topic, least(1.0, (SELECT max_by(c, r) FROM c WHERE c * r <= 1) * r) AS p FROM c)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.p, 6) AS probability, d.u < p.p AS kept
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic
"""
