"""JSON records in, tables out: readers that refuse bad input, writers that refuse to change what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WRAPPERS = ("records", "questions", "data", "annotations", "items")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; a malformed line fails the read, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole files: an array of objects, an object around an array, or one object."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))  # fails for repeated keys
    inner = F.coalesce(*[F.try_variant_get("v", f"$.{w}", "array<variant>") for w in WRAPPERS], F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return whole.select(F.explode(inner).alias("r")).select(F.from_json(F.to_json("r"), schema if not isinstance(schema, str) else kind).alias("r")).select("r.*")


def violations_of_json(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is no strict JSON."""
    return df.where(F.try_parse_json(column).isNull())


def merge_parts(parts: dict[str, DataFrame], routing: DataFrame) -> DataFrame:
    """Parts in the order that ``routing`` (part, ordinal, position) gives their rows (ordinal).

    A row without route, a route without row and a row that comes twice raise UNROUTED at run time.
    """
    all_ = None
    for name, df in parts.items():
        df = df.withColumn("part", F.lit(name))
        all_ = df if all_ is None else all_.unionByName(df)
    n = all_.groupBy("part", "ordinal").agg(F.count("*").alias("_n"))
    routes = routing.select("part", "ordinal", "position").join(n, ["part", "ordinal"], "full")
    fits = F.col("position").isNotNull() & (F.col("_n") == 1)
    where = F.concat_ws(":", "part", F.col("ordinal").cast("string"))
    routes = routes.where(F.when(F.coalesce(fits, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("UNROUTED: "), where)))).drop("_n")
    return routes.join(all_, ["part", "ordinal"], "left").orderBy("position")


def explicit_ids(df: DataFrame, json: str) -> DataFrame:
    """Distinct ids of records and id lists anywhere in a JSON text."""
    from ..functions.json_walk import explicit_ids as walk

    return df.select(F.explode(walk(F.col(json))).alias("id")).distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value, record, error) of every line that is not blank; record is null and error says why for what is no strict JSON object.

    Numbers count from 1 within a file, which is read as a whole.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))
    lines = whole.select("file", F.posexplode("lines").alias("at", "value")).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    error = F.when(v.isNull(), "invalid_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object")
    return lines.select("file", (F.col("at") + 1).alias("line_number"), "value", v.alias("record"), error.alias("error"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, digest): sha256 of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


def digest_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, what): files that are new, gone or changed between two tables of digests."""
    j = before.select("path", F.col("digest").alias("a")).join(after.select("path", F.col("digest").alias("b")), "path", "full")
    what = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", what.alias("what")).where("what is not null")


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("errorifexists").format(fmt).save(path)


def write_by_role(df: DataFrame, path: str, role: str = "dataset_role") -> None:
    df.write.mode("errorifexists").partitionBy(role).json(path)


def table_digest(df: DataFrame) -> tuple[int, int, int]:
    """Number of rows and two sums of row hashes: equal for tables with the same rows in any order."""
    row = F.struct(*sorted(df.columns))
    h = [F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    n, a, b = df.agg(F.count("*"), *h).first()
    return n, int(a or 0), int(b or 0)


def write_batch(outputs: dict[str, DataFrame], overwrite: bool = False, fmt: str = "parquet") -> dict[str, str]:
    """Several tables or none: all are written beside their places, then moved there; each place's status.

    A place that has the same rows already is ``unchanged``.  Without ``overwrite`` a place with other rows stops
    the batch before anything is moved; with it, it is ``overwritten``.  Others are ``written``.
    """
    if not outputs:
        return {}
    spark = next(iter(outputs.values())).sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def place(p: str):
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf), path

    used = [p for p in outputs if (fp := place(p))[0].exists(fp[1])]
    status = dict.fromkeys(outputs, "written")
    try:
        for p, df in outputs.items():
            df.write.mode("overwrite").format(fmt).save(p + ".staged")
        for p in used:
            there, made = spark.read.format(fmt).load(p), spark.read.format(fmt).load(p + ".staged")
            same = sorted(there.columns) == sorted(made.columns) and table_digest(there) == table_digest(made)
            status[p] = "unchanged" if same else "overwritten"
        if "overwritten" in status.values() and not overwrite:
            raise FileExistsError(", ".join(p for p in used if status[p] == "overwritten"))
        for p in outputs:
            if status[p] == "unchanged":
                continue
            fs, path = place(p)
            if fs.exists(path):
                fs.delete(path, True)
            if not fs.rename(place(p + ".staged")[1], path):
                raise OSError(f"{p} was not moved into place")
    finally:
        for p in outputs:
            fs, path = place(p + ".staged")
            if fs.exists(path):
                fs.delete(path, True)
    return status


def canonical_lines(df: DataFrame, *order: str) -> DataFrame:
    """(position-ordered) JSON lines with keys in the order of their names."""
    return df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def collisions(inputs: list[str], outputs: list[str]) -> list[str]:
    """Outputs that are an input, or lie within one, or hold one."""
    clean = lambda p: p.rstrip("/")
    return [o for o in outputs if any(clean(o) == clean(i) or clean(o).startswith(clean(i) + "/") or clean(i).startswith(clean(o) + "/") for i in inputs)]
