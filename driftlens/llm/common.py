"""What the operators of this subpackage share: words, shared storage, connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; GAP separates words.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Bounds what a Python worker and the JVM beside it hold of long texts at once. A setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lean(run):
    """``run``, for mapInArrow, in a worker that gives what it has freed back to the system when the task ends.

    Workers are kept for later tasks, and an allocator keeps the memory of its largest one; with a JVM beside them that adds up.
    """

    def wrapped(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often ``body`` uses it, lambdas included."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftlens-")
        atexit.register(shutil.rmtree, found[len("file://"):], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders made in the shared one and not deleted yet, oldest first.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, where = file_system(spark, path)
        fs.delete(where, True)
        if path in _MADE:
            _MADE.remove(path)


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write to the shared folder and read back: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def settle(spark: SparkSession, make, name: str) -> tuple[DataFrame, str]:
    """What ``make()`` gives, written to the shared folder, and where; the folders that were made on the way go."""
    before = set(_MADE)
    out, path = materialise(make(), name)
    delete(spark, *[p for p in _MADE if p not in before and p != path])
    return out, path


def settled(spark: SparkSession, make, name: str) -> DataFrame:
    return settle(spark, make, name)[0]


def reclaim(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` between longs: rows (node, component), component the smallest node.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to their ends by
    pointer jumping, and contracts the edges; the ends are local minima, at most half of the nodes that have edges left,
    so rounds and jumps are logarithmic even on long chains. Only groupings that combine on the map side and sort-merge
    joins touch the edges, so hubs don't gather in one task, and every step is written to the shared folder, so plans stay
    short. Null ends and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    old: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = materialise(df, name)
        old.append(path)
        return df

    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        hook = kept(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hook")
        while True:
            jump = hook.select(F.col("node").alias("up"), F.col("up").alias("far"))
            if hook.join(jump, "up", "left_semi").isEmpty():
                break
            hook = kept(hook.join(jump, "up", "left").select("node", F.coalesce("far", "up").alias("up")), "hook")
        found = found.join(hook.select(F.col("node").alias("component"), "up"), "component", "left")
        found = kept(found.select("node", F.coalesce("up", "component").alias("component")), "found")
        for end in ("a", "b"):
            edges = edges.join(hook.select(F.col("node").alias(end), "up"), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = kept(edges, "edges")
    found, _ = materialise(found, "components")
    delete(spark, *old)
    return found
