"""Helpers shared by the corpus operators: word rules, shared storage, graph components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). In local mode a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value):
    """Actions inside run with a session setting, which is put back after them."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, survives lost executors.

    Columns that are packed already go with compression none: a codec would hold buffers as large as their values. The
    shuffles of the write go once the table stands.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with setting(df.sparkSession, _CLEAN, "true"):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Removes a table that `stored` wrote, once nothing that is still to run reads it."""
    folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
    context = table.sparkSession.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batch_rows(spark: SparkSession, n: int):
    """Actions inside send rows to Python in batches of n."""
    return setting(spark, _BATCH, n)


def text_batches(spark: SparkSession, n: int = 1000) -> None:
    """Texts go to Python in batches of at most n rows from now on: a default batch of long ones is too much."""
    if not 0 < int(spark.conf.get(_BATCH)) <= n:
        spark.conf.set(_BATCH, n)


def release() -> None:
    """Gives a Python worker's freed memory back to the system: workers outlive their tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def input_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of the given text columns, counted over all rows."""
    total = sum((F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in columns), F.lit(0).cast("long"))
    return int(df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0])


def lower_ascii(text):
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of edges(a, b): (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps. Each round is written to the shared folder, so a lost executor
    costs one round; only the number and the checksum of the edges reach the driver. The rounds grow with the logarithm
    of the nodes; should `rounds` not be enough, it raises and returns nothing unfinished.
    """
    def minimum(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for turn in range(rounds + 1):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        if turn == rounds:
            raise RuntimeError(f"components are unfinished after {rounds} rounds")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = minimum(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        star = large.join(minimum(large), "a")
        last, now = now, stored(star.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        forget(last)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(roots)
