"""Families of records by signature: counts, coverage, rarefaction, novelty, transfer, support.

Records are (position, sig, ...): position counts from 1 in a committed order.  A
family are the records with one signature.  Everything is grouped by signature
first, so later steps work on one row a family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = 1000  # blocks that one task sums

def positions(df: DataFrame, lead: str, *rest: str, name: str = "position") -> DataFrame:
    """Number rows from 1 in the order of (lead, rest): numbers within each lead value, plus the rows of the values before it.

    No task orders all rows; only counts, one row a lead value, meet in one.
    """
    before = F.sum("_n").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1))
    offsets = df.groupBy(F.col(lead).alias("_lead")).agg(F.count("*").alias("_n")).select("_lead", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(lead).orderBy(*rest))
    return df.withColumn("_own", own).join(offsets, F.col(lead).eqNullSafe(F.col("_lead"))).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_own", "_lead", "_before")


def block_of(position: Column, size: int = 10) -> Column:
    return F.floor((position - 1) / size) + 1


def event_sequences(events: DataFrame) -> DataFrame:
    """(user_id, day, part, position, fine, contracted, topology, n): the ordered event types of each user and day.

    fine: as they come; contracted: runs of one type once; topology: the length.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"])
    out = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(steps.alias("steps"))
    runs = F.filter(F.col("steps"), lambda x, i: (i == 0) | (x != F.element_at("steps", F.greatest(i, F.lit(1)))))
    out = out.select(
        "user_id", "day", (F.col("user_id") % 5).alias("part"), F.array_join("steps", ">").alias("fine"), F.array_join(runs, ">").alias("contracted"),
        F.size("steps").cast("string").alias("topology"), F.size("steps").alias("n"), "steps",
    )
    return positions(out, "day", "user_id")


def counts(records: DataFrame, sig: str = "sig") -> DataFrame:
    return records.groupBy(F.col(sig).alias("sig")).agg(F.count("*").alias("n"))


def ranked(families: DataFrame) -> DataFrame:
    """Families numbered by descending count, then signature."""
    return families.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "sig")))


def summary(families: DataFrame) -> DataFrame:
    """Numbers of records, families, singletons, doubletons; unseen mass by Good and Turing."""
    return families.agg(
        F.sum("n").alias("records"), F.count("*").alias("families"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") == 2).alias("doubletons"),
        F.round(F.try_divide(F.count_if(F.col("n") == 1), F.sum("n")), 9).alias("singleton_mass"),
    )


def topk_coverage(families: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(k, coverage): share of records in the k largest families."""
    of = families.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    top = ranked(families).where(F.col("rank") <= max(ks)).select("rank", "n")
    total = families.agg(F.sum("n").alias("total"))
    return F.broadcast(of).join(top, F.col("rank") <= F.col("k")).groupBy("k").agg(F.sum("n").alias("c")).crossJoin(F.broadcast(total)).select("k", F.round(F.col("c") / F.col("total"), 9).alias("coverage"))


def rarefaction(families: DataFrame, step: int = 10) -> DataFrame:
    """(s, expected): families expected in s records drawn without replacement, for s = step, 2 step, ... and all.

    One row a family size, not a family: of N records there are N / step values of s, and at most the root of 2 N sizes.
    A cell costs the same at any size: the binomials are taken by logarithms of factorials.
    """
    sizes = families.groupBy("n").agg(F.count("*").alias("f"))
    total = families.agg(F.sum("n").alias("total"))
    steps = F.array_distinct(F.concat(F.when(F.col("total") >= step, F.sequence(F.lit(step).cast("long"), "total", F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>")), F.array("total")))
    s = total.select("total", F.explode(steps).alias("s"))
    absent = F.when(F.col("total") - F.col("n") < F.col("s"), 0.0).otherwise(F.exp(_log_factorial(F.col("total") - F.col("n")) + _log_factorial(F.col("total") - F.col("s")) - _log_factorial(F.col("total") - F.col("n") - F.col("s")) - _log_factorial(F.col("total"))))
    return s.join(sizes).groupBy("s").agg(F.round(F.sum(F.col("f") * (1 - absent)), 4).alias("expected"))


def _log_factorial(k: Column) -> Column:
    """log(k!): exact up to 20, beyond that by Stirling's series, whose error is below 1e-12 there."""
    x = k.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046728 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def first_seen(records: DataFrame) -> DataFrame:
    return records.groupBy("sig").agg(F.min("position").alias("first"))


def cumulative_curve(records: DataFrame, size: int = 10) -> DataFrame:
    """(position, families): distinct signatures so far at the end of each block."""
    new = first_seen(records).groupBy(block_of(F.col("first"), size).alias("block")).agg(F.count("*").alias("new"))
    ends = records.groupBy(block_of(F.col("position"), size).alias("block")).agg(F.max("position").alias("position"))
    blocks = ends.join(new, "block", "left").select("block", "position", F.coalesce("new", F.lit(0)).alias("new"), F.floor(F.col("block") / SPAN).alias("span"))
    # sums within spans of blocks, and of the spans before: only one row a span meets in one task
    before = F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = blocks.groupBy("span").agg(F.sum("new").alias("n")).select("span", F.coalesce(before, F.lit(0)).alias("before"))
    return blocks.join(spans, "span").select("position", (F.sum("new").over(Window.partitionBy("span").orderBy("block")) + F.col("before")).alias("families"))


def block_novelty(records: DataFrame, size: int = 10) -> DataFrame:
    """(block, records, novel_records, new_families): every record of a family that is new in its block counts."""
    r = records.withColumn("block", block_of(F.col("position"), size)).groupBy("block", "sig").agg(F.count("*").alias("n"))
    r = r.join(r.groupBy("sig").agg(F.min("block").alias("first")), "sig")
    new = F.col("first") == F.col("block")
    return r.groupBy("block").agg(F.sum("n").alias("records"), F.coalesce(F.sum(F.when(new, F.col("n"))), F.lit(0)).alias("novel_records"), F.count_if(new).alias("new_families"))


def sequential_and_baseline(records: DataFrame, prefix: int, size: int = 10) -> DataFrame:
    """(block, sequential, baseline): records after the prefix that are new to all blocks before, and new to the prefix."""
    first = records.groupBy("sig").agg(F.min(F.when(F.col("position") > prefix, block_of(F.col("position"), size))).alias("first"), F.max(F.when(F.col("position") <= prefix, 1)).alias("known"))
    later = records.where(F.col("position") > prefix).withColumn("block", block_of(F.col("position"), size)).groupBy("block", "sig").agg(F.count("*").alias("n")).join(first, "sig")
    new = F.col("known").isNull()
    zero = F.lit(0)
    return later.groupBy("block").agg(F.coalesce(F.sum(F.when(new & (F.col("first") == F.col("block")), F.col("n"))), zero).alias("sequential"), F.coalesce(F.sum(F.when(new, F.col("n"))), zero).alias("baseline"))


def transfer(records: DataFrame, prefix: int) -> DataFrame:
    """How many records after the prefix have a signature of the prefix."""
    after, before = F.col("position") > prefix, F.col("position") <= prefix
    f = records.groupBy("sig").agg(F.count_if(after).alias("later"), F.count_if(before).alias("seen"))
    hit = F.coalesce(F.sum(F.when(F.col("seen") > 0, F.col("later"))), F.lit(0))
    return f.agg(F.sum("later").alias("expansion"), hit.alias("transferred"), F.round(F.try_divide(hit, F.sum("later")), 9).alias("rate"))


def absorption(records: DataFrame, fine: str, coarse: str, prefix: int) -> DataFrame:
    """Of later records with a new fine signature, those whose coarse signature the prefix has."""
    known = [records.where(F.col("position") <= prefix).select(F.col(c).alias(c)).distinct().withColumn(f"k_{c}", F.lit(1)) for c in (fine, coarse)]
    later = records.where(F.col("position") > prefix).groupBy(fine, coarse).agg(F.count("*").alias("n")).join(known[0], fine, "left").join(known[1], coarse, "left")
    novel = F.coalesce(F.sum(F.when(F.col(f"k_{fine}").isNull(), F.col("n"))), F.lit(0))
    absorbed = F.coalesce(F.sum(F.when(F.col(f"k_{fine}").isNull() & F.col(f"k_{coarse}").isNotNull(), F.col("n"))), F.lit(0))
    return later.agg(novel.alias("novel_fine"), absorbed.alias("absorbed"), F.round(F.try_divide(absorbed, novel), 9).alias("rate"))


def partition_support(records: DataFrame, prefix: int, size: int = 10) -> DataFrame:
    """Families new after the prefix: records, partitions and blocks that hold them, and whether that is material."""
    f = records.groupBy("sig").agg(
        F.min("position").alias("first"), F.count("*").alias("n_records"), F.countDistinct("part").alias("n_parts"), F.countDistinct(block_of(F.col("position"), size)).alias("n_blocks")
    )
    f = f.where((F.col("first") > prefix) & (F.col("n_records") >= 2))
    return f.select("sig", "n_records", "n_parts", "n_blocks", ((F.col("n_records") >= 3) & (F.col("n_parts") >= 2) & (F.col("n_blocks") >= 2)).alias("material"))


def dominant(records: DataFrame, sig: str) -> DataFrame:
    """The largest family, the smallest signature among equals."""
    return counts(records, sig).orderBy(F.desc("n"), "sig").limit(1)


def dominant_inflation(records: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Records that the dominant coarse family has beyond the dominant fine one."""
    a = F.broadcast(dominant(records, fine).select(F.col("sig").alias("fine_sig"), F.col("n").alias("fine_n")))
    b = F.broadcast(dominant(records, coarse).select(F.col("sig").alias("coarse_sig"), F.col("n").alias("coarse_n")))
    one = a.crossJoin(b)  # one row each
    extra = F.count_if((F.col(coarse) == F.col("coarse_sig")) & (F.col(fine) != F.col("fine_sig")))
    return records.join(F.broadcast(one)).groupBy("fine_sig", "fine_n", "coarse_sig", "coarse_n").agg(extra.alias("added"))


def partition_profile(records: DataFrame) -> DataFrame:
    return records.groupBy("part").agg(F.count("*").alias("n_records"), F.min("position").alias("first"), F.max("position").alias("last"), F.round(F.avg("n"), 9).alias("mean_steps"))


def crosswalk(records: DataFrame, coarse: str, others: dict[str, str]) -> DataFrame:
    """(coarse, kind, sig, n) of each other signature within each coarse family."""
    pairs = F.explode(F.create_map(*[x for k, c in others.items() for x in (F.lit(k), F.col(c))])).alias("kind", "sig")
    return records.select(F.col(coarse).alias("coarse"), pairs).groupBy("coarse", "kind", "sig").agg(F.count("*").alias("n"))


def tail_blocks(blocks: DataFrame, k: int) -> DataFrame:
    """The last k blocks."""
    return blocks.orderBy(F.desc("block")).limit(k)


def examples(records: DataFrame, sig: str, id_: str, k: int = 3) -> DataFrame:
    """(sig, examples): the first k ids of each family in order of position; at most k rows of a family leave a task."""
    first = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(id_).alias("id")))), lambda x: x["id"])
    near = records.select(F.col(sig).alias("sig"), "position", id_).withColumn("_part", F.floor(F.col("position") / 4096))
    for by in (["sig", "_part"], ["sig"]):  # within parts first, so that a large family is no single task
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("position", id_))).where(F.col("_r") <= k)
    return near.groupBy("sig").agg(first.alias("examples"))


def top_families(records: DataFrame, sig: str, id_: str, k: int = 20, n_examples: int = 3) -> DataFrame:
    """(rank, sig, n, examples) of the k largest families, the smaller signature first among equals."""
    top = counts(records, sig).orderBy(F.desc("n"), "sig").limit(k)
    top = ranked(top)
    return top.join(examples(records.join(F.broadcast(top.select(F.col("sig").alias(sig))), sig, "left_semi"), sig, id_, n_examples), "sig")


def prefix_summaries(records: DataFrame, prefixes: tuple[int, ...]) -> DataFrame:
    """(prefix, records, families, singletons, doubletons, singleton_mass) of the first records, for each prefix."""
    sizes = [F.count_if(F.col("position") <= p).alias(f"n{p}") for p in prefixes]
    f = records.groupBy("sig").agg(*sizes).select(F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"n{p}").alias("n")) for p in prefixes])).alias("x")).select("x.*").where("n > 0")
    once = F.count_if(F.col("n") == 1)
    return f.groupBy("prefix").agg(F.sum("n").alias("records"), F.count("*").alias("families"), once.alias("singletons"), F.count_if(F.col("n") == 2).alias("doubletons"), F.round(once / F.sum("n"), 9).alias("singleton_mass"))


def record_profile(records: DataFrame, status: str, uncertain: Column, other: Column, nodes: Column) -> DataFrame:
    """Numbers of records, by status, of uncertain ones and of those with an OTHER role; mean number of nodes."""
    n = F.count("*")
    by = records.groupBy(F.col(status).alias("_s")).agg(n.alias("n"), F.count_if(uncertain).alias("u"), F.count_if(other).alias("o"), F.sum(nodes).alias("nodes"), F.count(nodes).alias("graphs"))
    share = lambda c: F.round(F.try_divide(F.sum(c), F.sum("n")), 9)
    return by.agg(
        F.sum("n").alias("records"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_s", "n"))))).alias("status_counts"), F.sum("u").alias("uncertain"), share("u").alias("uncertain_rate"),
        F.sum("o").alias("other"), share("o").alias("other_rate"), F.round(F.try_divide(F.sum("nodes"), F.sum("graphs")), 9).alias("mean_nodes"),
    )


def family_library(records: DataFrame, prefix: int, size: int = 10) -> DataFrame:
    """A row a family: members, tier, stratum, quota, first and last place, parts, blocks, distinct finer signatures, members in and after the prefix."""
    from ..functions.text import evidence_tier, frequency_stratum

    n = F.count("*")
    f = records.groupBy("sig").agg(
        n.alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.countDistinct("part").alias("n_parts"), F.countDistinct(block_of(F.col("position"), size)).alias("n_blocks"),
        F.countDistinct("fine").alias("n_fine"), F.countDistinct("topology").alias("n_topology"), F.count_if(F.col("position") <= prefix).alias("in_prefix"),
    )
    quota = F.least(F.col("n"), 1 + F.ceil(F.log2("n"))).cast("long")
    return f.withColumns({"tier": evidence_tier(F.col("n")), "stratum": frequency_stratum(F.col("n")), "quota": quota, "new": F.col("in_prefix") == 0})
