"""Sinks. Data goes out through Spark's writers; small JSON through the driver's Hadoop file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PATHS, SEED, UNITS
from .tables import dumps


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_stats(stats: DataFrame, path: str) -> None:
    """One CSV with a header: a row per ticker."""
    cols = ["ticker", "median_bars_per_day", "trading_days", "total_returns", "liquidity_class"]
    stats.select(*cols).orderBy("ticker").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_split(split: DataFrame, path: str) -> None:
    sides: dict[str, list[str]] = {"train": [], "eval": []}
    for r in split.orderBy("ticker").toLocalIterator():  # names of instruments
        sides[r.side].append(r.ticker)
    write_text(split.sparkSession, path, dumps(sides))


def write_norm_stats(stats: DataFrame, path: str) -> None:
    rows = {r.ticker: {"mean": r["mean"], "std": r["std"]} for r in stats.orderBy("ticker").toLocalIterator()}
    write_text(stats.sparkSession, path, dumps(rows))


def write_manifest(spark: SparkSession, path: str, window_len: int, mean: float, std: float, n: int = PATHS, seed: int = SEED) -> dict:
    m = {"window_len": window_len, "benchmark_n_paths": n, "benchmark_seed": seed, "reference_mean": mean, "reference_std": std, "units": UNITS}
    write_text(spark, path, dumps(m))
    return m


def write_corpus(corpus: DataFrame, path: str, single: bool = False) -> None:
    """Path form as Parquet; values in single precision with ``single``."""
    out = corpus.withColumn("values", F.col("values").cast("array<float>")) if single else corpus
    out.select("path_id", "ticker", "regime", "values").write.mode("overwrite").parquet(path)
