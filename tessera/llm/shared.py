"""Places that the driver and all executors share, shipping of the package, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers find it wherever they start."""
    # rows of text and of shingle sets can be long: small batches bound the memory of a task; no result depends on it
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="tessera-ship-")
    archive = os.path.join(folder, "tessera_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(os.path.join(root, "tessera")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs in one process (local tests), an own one.

    On a cluster an unset folder is an error: executors would write to disks that nobody else reads.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


_made: list[str] = []


def _place(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def discarded_at_end(spark: SparkSession, path: str) -> None:
    """What is at ``path`` goes when the driver ends, if it has not gone before."""
    files, path = _place(spark, path)
    files.deleteOnExit(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, kept when executors are lost, gone when the driver ends."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _made.append(path)
    discarded_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            files, path = _place(spark, folder)
            files.delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``written`` makes inside go at the end, but for those that are passed to what this gives."""
    start, kept = len(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles())
        return df

    yield keep
    for path in _made[start:]:
        if path.rpartition("/")[2] not in kept:
            files, at = _place(spark, path)
            files.delete(at, True)
    _made[start:] = [p for p in _made[start:] if p.rpartition("/")[2] in kept]


def hash_sample(df: DataFrame, id_: str, n: int, *ties: str) -> DataFrame:
    """At most n rows, those with the smallest hash of ``id_``.

    A bound on the hash, from the number of rows, leaves about 1.2 n rows before
    they are ordered, so tasks don't each send their n smallest to the driver.
    """
    total = df.count()
    if total > 1.2 * n:
        df = df.where(F.xxhash64(id_) < int(-(1 << 63) + (1 << 64) * 1.2 * n / total))
    return df.orderBy(F.xxhash64(id_), id_, *ties).limit(n)


def hash_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value of the top ``bits`` bits of the long ``column``: a filter of 2 ** (bits - 3) bytes at any size."""
    slots = hashes.select((F.shiftrightunsigned(F.col(column), 64 - bits) + 1).alias("slot")).distinct()
    chunks = slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in chunks.toLocalIterator():  # bucket numbers count from 1
        out[(r.at - 1) * 4096 : r.at * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def may_hold(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where ``hash_filter`` has the bit of the 64-bit hash."""
    slot = (hashes.view(np.uint64) >> np.uint64(64 - 3 - (len(filter_) - 1).bit_length())).astype(np.int64)
    return ((filter_[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 64) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the edges.

    Each round takes the smallest label among neighbours, then the label of that
    label, so paths shrink by half at least.  Only tables of nodes are shuffled,
    minima are taken before the exchange, nothing is collected.  Every round is
    written to the shared folder.
    """
    spark = edges.sparkSession
    # written first: edges that are one of several right choices must not be made twice
    e = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")), "raw-edges")
    e = written(e.union(e.select("y", "x")).where("x <> y").distinct(), "edges")
    labels = written(e.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = e.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("up"))
        new = written(step.join(jump, "via", "left").select("node", "was", F.least("via", F.coalesce("up", "via")).alias("label")), "labels")
        old, labels = labels, new.select("node", "label")
        changed = new.where("was <> label").limit(1).count()
        remove(spark, old)
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

