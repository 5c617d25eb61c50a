"""The plan's query operators as DataFrame functions.

Tables are wide DataFrames; a column's links are an array of document ids.  Sets
are one-column DataFrames (``value``).  A breach that only data show raises at run
time by ``raise_error`` with the breach's code, in the query that computes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_number(c: Column) -> Column:
    """The number that a text is, thousands separators allowed; null: none."""
    text = F.trim(F.regexp_replace(c.cast("string"), ",", ""))
    return F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def to_date(c: Column) -> Column:
    """The date that a text is in ISO form; null: none."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def normalize(c: Column, how: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))) if how == "casefold_trim" else c


def predicate(column: Column, kind: str, value) -> Column:
    """One of the closed predicate kinds; a null or unreadable cell never holds."""
    match kind:
        case "eq":
            test = column == F.lit(value)
        case "contains":
            test = F.contains(column, F.lit(value))
        case "in":
            test = column.isin(*value)
        case "numeric_eq":
            test = to_number(column) == F.lit(float(value))
        case "numeric_gt":
            test = to_number(column) > F.lit(float(value))
        case "numeric_lt":
            test = to_number(column) < F.lit(float(value))
        case _:
            raise ValueError(f"no predicate {kind}")
    return F.coalesce(test, F.lit(False))


def filter_rows(rows: DataFrame, column: str, kind: str, value) -> DataFrame:
    return rows.where(predicate(F.col(column), kind, value))


def exactly_one(values: DataFrame) -> DataFrame:
    """The single value; CARDINALITY_MISMATCH at run time for none or several."""
    n = F.count(F.lit(1))
    return values.agg(F.when(n == 1, F.max("value")).otherwise(F.raise_error(F.concat(F.lit("CARDINALITY_MISMATCH: "), n.cast("string"), F.lit(" values")))).alias("value"))


def project(rows: DataFrame, column: str, mode: str = "text", cardinality: str = "many") -> DataFrame:
    out = rows.select(F.explode(column).alias("value")) if mode == "links" else rows.select(F.col(column).alias("value"))
    return exactly_one(out) if cardinality == "one" else out


def retrieve(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(value, text) of linked documents; entities without document are left out, see ``missing_documents``."""
    return entities.join(documents.select(F.col("document_id").alias("value"), "text"), "value")


def retrieve_all(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """As ``retrieve``; MISSING_LINK at run time for a null entity, MISSING_DOCUMENT for one without document."""
    ids = documents.select(F.col("document_id").alias("value"))
    known = ids.join(entities, "value", "left_semi").distinct().withColumn("_known", F.lit(True))  # no larger than the entities
    seen = entities.join(known, "value", "left")
    why = F.when(F.col("value").isNull(), F.lit("MISSING_LINK: no entity")).otherwise(F.concat(F.lit("MISSING_DOCUMENT: "), F.col("value")))
    return retrieve(entities, documents).union(breach(seen, F.col("_known").isNull(), why, ["value", "text"]))


def breach(rows: DataFrame, broken: Column, message: Column, columns: list[str]) -> DataFrame:
    """No rows, with the given columns as nulls; raises at run time if a row is broken.

    The test stays with the raise in one expression: a raise alone is a filter that moves below a join and meets all rows.
    """
    return rows.where(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(False)).select(*[F.lit(None).alias(c) for c in columns])


def missing_documents(entities: DataFrame, documents: DataFrame) -> DataFrame:
    return entities.join(documents.select(F.col("document_id").alias("value")), "value", "left_anti")


def join_rows(rows: DataFrame, column: str, keys: DataFrame, match: str = "exact") -> DataFrame:
    """Rows whose column equals a key."""
    how = "casefold_trim" if match == "normalized" else "none"
    keys = keys.select(normalize(F.col("value"), how).alias("_key")).where("_key is not null").distinct()
    return rows.join(keys, normalize(F.col(column), how) == F.col("_key"), "left_semi")


def join_once(rows: DataFrame, column: str, keys: DataFrame, match: str = "exact") -> DataFrame:
    """As ``join_rows``; NO_MATCH at run time for a key without row, AMBIGUOUS_MATCH for one with several."""
    how = "casefold_trim" if match == "normalized" else "none"
    found = join_rows(rows, column, keys, match)
    n = found.groupBy(normalize(F.col(column), how).alias("_key")).agg(F.count("*").alias("_n"))
    seen = keys.select(normalize(F.col("value"), how).alias("_key")).distinct().join(n, "_key", "left")
    why = F.concat(F.when(F.col("_n").isNull(), "NO_MATCH: ").otherwise("AMBIGUOUS_MATCH: "), F.coalesce(F.col("_key").cast("string"), F.lit("null")))
    return found.union(breach(seen, F.col("_n").isNull() | (F.col("_n") > 1), why, found.columns))


def ambiguous_keys(rows: DataFrame, column: str) -> DataFrame:
    """Keys that match more than one row, with their number of rows."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def aggregate(values: DataFrame, function: str) -> DataFrame:
    """One number; an empty set has a count, and nothing else."""
    made = {"count": F.count("value").cast("double"), "sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"), "average": F.avg("value")}[function]
    if function != "count":
        made = F.when(F.count("value") > 0, made).otherwise(F.raise_error(F.lit("EMPTY_INPUT: nothing to aggregate")))
    return values.agg(made.alias("value"))


def compare(left: Column, right: Column, relation: str) -> Column:
    return {"eq": left == right, "lt": left < right, "gt": left > right, "le": left <= right, "ge": left >= right}[relation]


def keyed_extreme(rows: DataFrame, by: list[str], key: str, value: str, mode: str = "max") -> DataFrame:
    """For each group all keys with the extreme value (ties are shown, not broken).  Extremes are aggregated before the join."""
    best = rows.groupBy(*by).agg((F.max if mode == "max" else F.min)(value).alias("_best"))
    return rows.join(best, by).where(F.col(value) == F.col("_best")).select(*by, key, value)


def select_keys(values: DataFrame, mode: str, parse: str, tie_policy: str) -> DataFrame:
    """Keys (``value``) of the extreme of (key, value); ``error``: PARSE_FAILURE, TIE or EMPTY_INPUT at run time, ``all``: tied keys are all given."""
    read = {"Number": to_number, "Date": to_date}.get(parse, lambda c: c)(F.col("value"))
    read = F.when(read.isNotNull(), read).otherwise(F.raise_error(F.concat(F.lit("PARSE_FAILURE: "), F.coalesce(F.col("value").cast("string"), F.lit("null")))))
    read_values = values.select("key", read.alias("_v"))
    best = read_values.agg((F.max if mode == "max" else F.min)("_v").alias("_m"))
    keys = read_values.crossJoin(F.broadcast(best)).where("_v = _m").select(F.col("key").alias("value")).distinct()  # one row on the right
    if tie_policy == "all":
        return keys
    n = F.count(F.lit(1))
    code = F.when(n == 0, "EMPTY_INPUT: nothing to select").otherwise("TIE: several keys are extreme")
    return keys.agg(F.when(n == 1, F.max("value")).otherwise(F.raise_error(code)).alias("value"))


def arg_extreme(rows: DataFrame, column: Column, mode: str = "max") -> DataFrame:
    """The one row with the extreme value; a tie is an error."""
    best = rows.withColumn("_v", column).where("_v is not null")
    top = best.crossJoin(F.broadcast(best.agg((F.max if mode == "max" else F.min)("_v").alias("_m")))).where("_v = _m").drop("_m")  # one row on the right
    n = F.count("*").over(Window.partitionBy("_v"))
    return top.withColumn("_n", n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("TIE: several rows are extreme")))).drop("_v", "_n")


def arithmetic(left: Column, right: Column, function: str) -> Column:
    match function:
        case "add":
            return left + right
        case "subtract":
            return left - right
        case "multiply":
            return left * right
    return F.when(right != 0, left / right).otherwise(F.raise_error(F.lit("DIVISION_BY_ZERO")))


def date_difference(left: Column, right: Column, unit: str) -> Column:
    """left - right in whole units."""
    if unit == "day":
        return F.datediff(left, right).cast("double")
    months = F.floor(F.months_between(left, right)).cast("double")
    return months if unit == "month" else F.floor(months / 12)


def distinct_values(values: DataFrame, normalization: str = "none") -> DataFrame:
    """One representative, the smallest, of each normalised value."""
    return values.where("value is not null").groupBy(normalize(F.col("value"), normalization).alias("_n")).agg(F.min("value").alias("value")).select("value")


# ---- readers of EXTRACT ----------------------------------------------------------------------------------------

# Our choice: a reader is a pattern for a value type; an attribute may have its own.
READERS = {
    "Number": r"[-+]?[0-9]+(?:\.[0-9]+)?",
    "Date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "email": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]",
    "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "String": r"[^.!?\n]+[.!?]",
}


# How a found text becomes a value; other types keep the text.
TYPED = {"Number": to_number, "Date": to_date, "Boolean": lambda c: F.when(F.lower(c).isin("yes", "true"), True).when(F.lower(c).isin("no", "false"), False)}


def register_reader(name: str, pattern: str) -> None:
    READERS[name] = pattern


def reader(attribute: str, value_type: str) -> str | None:
    """The pattern for an attribute: a reader named by one of its words, else that of its type."""
    for word in attribute.lower().split():
        if word in READERS:
            return READERS[word]
    return READERS.get(value_type)


def extract(documents: DataFrame, attribute: str, value_type: str, cardinality: str = "many") -> DataFrame:
    """Typed values that the reader finds, with their document's entity (``key``) where there is one; UNSUPPORTED_EXTRACTION without one.  ``one``: the first of the only document."""
    pattern = reader(attribute, value_type)
    if pattern is None:
        return documents.select(F.raise_error(F.lit(f"UNSUPPORTED_EXTRACTION: {attribute} as {value_type}")).cast("string").alias("value"))
    typed = TYPED.get(value_type, lambda c: c)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    key = [F.col("value").alias("key")] * ("value" in documents.columns)  # the entity that a document belongs to
    if cardinality == "one":
        return exactly_one(documents.select(typed(F.try_element_at(found, F.lit(1))).alias("value")).where("value is not null"))
    kept = ["key"] * len(key)
    return documents.select(*key, F.explode(found).alias("v")).select(*kept, typed(F.col("v")).alias("value")).where("value is not null")


def extract_by(documents: DataFrame, id_: str, attribute: str, value_type: str) -> DataFrame:
    """(id, value) of every value that the reader finds in a document."""
    typed = TYPED.get(value_type, lambda c: c)
    found = F.regexp_extract_all("text", F.lit(reader(attribute, value_type)), F.lit(0))
    return documents.select(id_, F.explode(found).alias("v")).select(id_, typed(F.col("v")).alias("value")).where("value is not null")


def sentences(text: Column) -> Column:
    """Sentences of a text: runs up to . ! ? or the end of a line."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
