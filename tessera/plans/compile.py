"""A checked plan becomes one lazy DataFrame; nothing runs until its result is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from .check import Report, check_plan


class PlanError(ValueError):
    def __init__(self, report: Report):
        super().__init__("; ".join(f"{c} at {p}" + f": {m}" * bool(m) for c, p, m in report.errors))
        self.report = report


def compile_plan(plan: dict, tables: dict[str, DataFrame], documents: DataFrame | None = None, links: dict[str, str] | None = None) -> DataFrame:
    """The answer as a DataFrame (``value``).

    tables: by table_id, columns in the plan's order; documents: (document_id,
    text); links: for a column's label the column that holds its link or array of links.
    """
    report = check_plan(plan)
    if not report.ok:
        raise PlanError(report)
    nodes = {n["id"]: n for n in plan["nodes"]}
    made: dict[str, DataFrame] = {}

    def value(ref: dict) -> DataFrame:
        return tables[plan["sources"][ref["source_id"]]["locator"]["table_id"]] if ref["kind"] == "source" else made[ref["node_id"]]

    live, stack = set(), [plan["answer"]["node_id"]]
    while stack:  # dead nodes are not built
        k = stack.pop()
        if k not in live:
            live.add(k)
            stack += [r["node_id"] for r in nodes[k]["inputs"].values() if r["kind"] == "node"]
    for k in report.order:
        if k in live:
            n = nodes[k]
            made[k] = _build(n["operator"], {r: value(x) for r, x in n["inputs"].items()}, n["arguments"], documents, links or {}, {r: report.types.get(x.get("node_id"), "Table") for r, x in n["inputs"].items()})
    return made[plan["answer"]["node_id"]].select("value")


def _link_column(rows: DataFrame, label: str, links: dict[str, str]) -> DataFrame:
    column = links.get(label, label)
    if dict(rows.dtypes)[column].startswith("array"):
        return rows.withColumn("_links", F.col(column))
    return rows.withColumn("_links", F.when(F.col(column).isNotNull(), F.array(F.col(column).cast("string"))))


def _build(operator: str, x: dict[str, DataFrame], a: dict, documents: DataFrame | None, links: dict[str, str], types: dict[str, str]) -> DataFrame:
    only = next(iter(x.values()))
    match operator:
        case "FILTER":
            p = a["predicate"]
            return R.filter_rows(only, p["column"]["label"], p["kind"], p["values"] if p["kind"] == "in" else p["value"])
        case "PROJECT":
            label = a["column"]["label"]
            if a["mode"] == "links":
                return R.project(_link_column(only, label, links), "_links", "links", a["cardinality"])
            return R.project(only.withColumn("_text", F.col(label).cast("string")), "_text", "text", a["cardinality"])
        case "RETRIEVE":
            if documents is None:
                raise ValueError("the plan needs documents")
            return R.retrieve_all(only, documents.select(F.col("document_id").cast("string").alias("document_id"), "text"))
        case "EXTRACT":
            return R.extract(only, a["attribute"], a["value_type"], a["cardinality"])
        case "JOIN":
            label = a["right_column"]["label"]
            return R.join_once(x["rows"], label, x["key"], a["match"])
        case "AGGREGATE":
            if "values" not in x:
                return only.agg(F.count("*").cast("double").alias("value"))
            number = only if dict(only.dtypes)["value"] != "string" or a["function"] == "count" else only.select(R.to_number(F.col("value")).alias("value"))
            return R.aggregate(number, a["function"])
        case "COMPARE":
            if a["return"] == "selection":
                if "key" not in only.columns:
                    raise ValueError("the values to select from have no keys")
                return R.select_keys(only, a["relation"], a["parse"], a["tie_policy"])
            both = x["left"].select(F.col("value").alias("l")).crossJoin(x["right"].select(F.col("value").alias("r")))  # one row each
            return both.select(R.compare(F.col("l"), F.col("r"), a["relation"]).alias("value"))
        case "PARSE":
            read = {"Number": R.to_number, "Date": R.to_date}[a["target_type"]](F.col("value"))
            return only.select(F.when(read.isNotNull(), read).otherwise(F.raise_error(F.concat(F.lit("PARSE_FAILURE: "), F.coalesce("value", F.lit("null"))))).alias("value"))
        case "ARG_EXTREME":
            label = F.col(a["column"]["label"])
            return R.arg_extreme(only, {"Number": R.to_number, "Date": R.to_date}.get(a["parse"], lambda c: c)(label), a["mode"])
        case "ARITHMETIC":
            both = x["left"].select(F.col("value").alias("l")).crossJoin(x["right"].select(F.col("value").alias("r")))  # one row each
            if types["left"] == "Date":
                return both.select(R.date_difference(F.col("l"), F.col("r"), a["unit"]).alias("value"))
            return both.select(R.arithmetic(F.col("l"), F.col("r"), a["function"]).alias("value"))
        case "DISTINCT":
            return R.distinct_values(only, a["normalization"])
    raise ValueError(f"no operator {operator}")
