"""Hybrid tables in cell form: cells, columns with their links, the closure of linked documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cells(df: DataFrame, row: Column, columns: list[str], links: dict[str, Column] | None = None) -> DataFrame:
    """(row_index, column_index, label, text, links) of a wide table; one pass, no shuffle."""
    empty = F.array().cast("array<string>")
    each = [F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("label"), F.col(c).cast("string").alias("text"), (links or {}).get(c, empty).alias("links")) for i, c in enumerate(columns)]
    return df.select(row.alias("row_index"), F.explode(F.array(*each)).alias("c")).select("row_index", "c.*")


def from_nested(tables: DataFrame) -> DataFrame:
    """Cell form of (table_id, data array<array<struct<text, links>>>)."""
    rows = tables.select("table_id", F.posexplode("data").alias("row_index", "row"))
    return rows.select("table_id", "row_index", F.posexplode("row").alias("column_index", "cell")).select("table_id", "row_index", "column_index", "cell.text", "cell.links")


def schema_view(cells_: DataFrame) -> DataFrame:
    """For each column its cells, blank cells, and whether any has links."""
    return cells_.groupBy("column_index", "label").agg(F.count("*").alias("n_cells"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_blank"), F.coalesce(F.bool_or(F.size("links") > 0), F.lit(False)).alias("has_links"))


def link_closure(cells_: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, n_links, found): all linked documents."""
    linked = cells_.select(F.explode("links").alias("document_id")).groupBy("document_id").agg(F.count("*").alias("n_links"))
    known = documents.select(F.col("document_id").cast("string").alias("document_id")).distinct().withColumn("found", F.lit(True))
    return linked.join(known, "document_id", "left").select("document_id", "n_links", F.coalesce("found", F.lit(False)).alias("found"))


def non_contiguous(cells_: DataFrame, by: str, index: str) -> DataFrame:
    """Groups whose indexes are not 0, 1, ... without gap or repetition."""
    g = cells_.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    return g.where("lo <> 0 or hi <> n - 1 or d <> n")


def to_wide(cells_: DataFrame, labels: list[str]) -> DataFrame:
    return cells_.groupBy("row_index").pivot("label", labels).agg(F.first("text"))


def committed(df: DataFrame, partition: str, *order: str) -> DataFrame:
    return df.withColumn("row_index", F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1)
