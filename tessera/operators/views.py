"""Views and packets: what a person or a model that answers may see of a record, and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType
from pyspark.sql.window import Window

from ..functions import text as X
from .rules import violation


def allowed(df: DataFrame, columns: list[str], **constants) -> DataFrame:
    """Exactly the listed columns and the constants; a listed column that is missing raises when the plan is made."""
    return df.select(*columns, *[F.lit(v).alias(k) for k, v in constants.items()])


def staged(df: DataFrame, id_: str, stage: str, columns: dict[str, list[str]]) -> DataFrame:
    """(id, stage, view): as JSON those columns that the row's stage shows; no row for other stages.

    Null columns are left out of the JSON.
    """
    view = F.lit(None).cast("string")
    for name, shown in columns.items():
        view = F.when(F.col(stage) == name, F.to_json(F.struct(*shown))).otherwise(view)
    return df.where(F.col(stage).isin(*columns)).select(id_, F.col(stage).alias("stage"), view.alias("view"))


def field_paths(kind: DataType, path: str = "$") -> list[str]:
    """Paths of all fields of a schema, those of nested structs, arrays ([*]) and maps (.*) too, in the order of the schema."""
    match kind:
        case StructType():
            return [p for f in kind.fields for p in (f"{path}.{f.name}", *field_paths(f.dataType, f"{path}.{f.name}"))]
        case ArrayType():
            return field_paths(kind.elementType, path + "[*]")
        case MapType():
            return field_paths(kind.valueType, path + ".*")
    return []


def exact_view(df: DataFrame, columns: list[str]) -> list[str]:
    """Paths that the view has beyond ``columns`` (paths without ``$.``) as ``extra``, and those that it lacks as ``missing``."""
    have, want = set(field_paths(df.schema)), {f"$.{c}" for c in columns}
    return sorted([f"extra: {p}" for p in have - want] + [f"missing: {p}" for p in want - have])


def free_text(df: DataFrame, forbidden: list[str]) -> list[str]:
    """Paths of the schema whose last name, without case and marks, is forbidden."""
    plain = lambda name: "".join(c for c in name.casefold() if c.isalnum())
    names = {plain(f) for f in forbidden}
    return [p for p in field_paths(df.schema) if plain(p.rsplit(".", 1)[1].replace("[*]", "")) in names]


def aliased(df: DataFrame, by: list[str], order: list[str], name: str = "observation") -> DataFrame:
    """Each row of a packet under a name of its own, name_01 and on, in the given order; ties by none: the order must be total."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("alias", F.format_string(f"{name}_%02d", n))


def steps_to_edges(steps: DataFrame, by: list[str], position: str, id_: str) -> DataFrame:
    """(by, id, depends_on): a list of steps as a chain; the first depends on nothing (null)."""
    before = F.lag(id_).over(Window.partitionBy(*by).orderBy(position))
    return steps.select(*by, id_, before.alias("depends_on"))


def blinded(pairs: DataFrame, id_: str, first: str, second: str) -> DataFrame:
    """(id, left, right): both answers without their origin; the side of the first follows from the id's hash."""
    at_left = X.hash_side(F.col(id_).cast("string")) == "left"
    return pairs.select(id_, F.when(at_left, F.col(first)).otherwise(F.col(second)).alias("left"), F.when(at_left, F.col(second)).otherwise(F.col(first)).alias("right"))


def packets(views: DataFrame, routing: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """(partition, id, view): each view in the partition of its route; UNROUTED at run time without one, repeated routes repeat the view."""
    r = routing.select(id_, "partition")
    known = F.when(F.col("partition").isNull(), F.raise_error(F.concat(F.lit("UNROUTED: "), F.col(id_).cast("string"))).cast("boolean")).otherwise(True)
    return views.join(r, id_, "left").where(known).select("partition", id_, F.to_json(F.struct(*columns)).alias("view"))


def bound_packets(packets_: DataFrame, assessments: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """Packets with the sha256 of the assessment that they rest on (``assessment_sha256``) and none of its content; null without one."""
    bound = assessments.select(id_, F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256).alias("assessment_sha256"))
    return packets_.join(bound, id_, "left")


def context_signature(**parts: Column) -> Column:
    """name=value of each part that is there, in the given order, joined by |; the empty text if none is."""
    return F.concat_ws("|", *[F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in parts.items()])


def attempts(df: DataFrame, by: str, attempt: str, submitted: str) -> DataFrame:
    """Attempts that are not numbered 1 to n, and records whose last attempt only was not the one submitted."""
    n = df.groupBy(by).agg(F.count("*").alias("_n"), F.countDistinct(attempt).alias("_d"), F.min(attempt).alias("_lo"), F.max(attempt).alias("_hi"), F.count_if(submitted).alias("_s"), F.max(F.when(F.col(submitted), F.col(attempt))).alias("_at"))
    gaps = (F.col("_lo") != 1) | (F.col("_hi") != F.col("_n")) | (F.col("_d") != F.col("_n"))
    last = (F.col("_s") != 1) | (F.col("_at") != F.col("_hi"))
    what = F.array_compact(F.array(F.when(F.coalesce(gaps, F.lit(True)), "not numbered 1 to n"), F.when(F.coalesce(last, F.lit(True)), "last attempt only is submitted")))
    return violation(n.select(by, F.explode(what).alias("_w")), "attempts", F.col(by), F.col("_w"))


def match_rates(pairs: DataFrame, stratum: str) -> DataFrame:
    """(stratum, pairs, exact, jaccard) of each stratum and of all: share of pairs with one set, mean similarity.

    pairs: a row a pair, n_left, n_right, n_both as ``agreement.jaccard`` gives them, and its jaccard.
    """
    same = ((F.col("n_both") == F.col("n_left")) & (F.col("n_both") == F.col("n_right"))).cast("double")
    name = F.when(F.grouping(stratum) == 1, "all").otherwise(F.col(stratum).cast("string"))
    rates = pairs.rollup(stratum).agg(F.count("*").alias("pairs"), F.round(F.avg(same), 6).alias("exact"), F.round(F.avg("jaccard"), 6).alias("jaccard"), name.alias("_name"))
    return rates.select(F.col("_name").alias("stratum"), "pairs", "exact", "jaccard")


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """(position, value): the lines of a Markdown table, head first, rows in the given order; for reports, whose rows are numbered in one task.

    | in a cell is escaped, line breaks become spaces, null is N/A, fractions have three decimals.
    """
    cell = lambda c, kind: X.shown(F.col(c)) if kind in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s*[\r\n]+\s*", " "), r"\|", r"\\\|")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    n = F.row_number().over(Window.orderBy(*order)) + 1
    rows = df.select(n.cast("int").alias("position"), line([clean(cell(c, kind)) for c, kind in df.dtypes]).alias("value"))
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return df.sparkSession.createDataFrame(list(enumerate(head)), "position int, value string").union(rows)
