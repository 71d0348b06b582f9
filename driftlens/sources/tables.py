"""Scans of the return-path side; the single place that knows file layouts."""

from __future__ import annotations

import json
import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CORPUS, MANIFEST, SPLIT

#: Environment variable that moves the output folder.
OUTPUT = "DRIFTLENS_OUTPUT"


def output_dir(default: str = "output") -> str:
    return os.environ.get(OUTPUT, default).rstrip("/")


def real_corpus(out: str | None = None) -> str:
    return f"{out or output_dir()}/eval"


def labels(out: str | None = None) -> str:
    """Ticker and regime of each path of the real corpus, as regenerated."""
    return f"{out or output_dir()}/eval_labels"


def manifest(out: str | None = None) -> str:
    return f"{out or output_dir()}/manifest.json"


def generator_corpora(names: list[str], out: str | None = None) -> dict[str, str]:
    return {n: f"{out or output_dir()}/{n}" for n in names}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bar_csvs(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("download_log.csv",)) -> DataFrame:
    """ticker (a file's stem), ts, close from a folder of minute CSVs; columns are found by name, others ignored.

    Each file's header is its own. The headers are read in one pass, a row per different one; files are then read in one scan for each
    of those, whatever their number. Files without a timestamp column give no rows, with a warning; one that has no close is an error. Names
    that look like nulls stay names.
    """
    name = F.col("_metadata.file_name")
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder).filter(~name.isin(*skip))
    first = lines.filter(F.col("_metadata.file_block_start") == 0).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    heads = first.groupBy("file").agg(F.min_by("value", "line").alias("head")).groupBy("head").agg(F.min("file").alias("example")).collect()  # a row per layout
    out, layouts = None, {}
    for row in heads:
        layouts.setdefault(tuple(c.strip().strip('"') for c in row["head"].lstrip("\ufeff").split(",")), []).append(row)
    for head, rows in sorted(layouts.items()):
        if "timestamp" not in head:
            warnings.warn(f"no timestamp column in files like {rows[0].example}: left out", stacklevel=2)
            continue
        if "close" not in head:
            raise KeyError(f"no close column in files like {rows[0].example}")
        kind = ", ".join(f"c{i} string" for i in range(len(head)))
        mine = lines.select(F.col("_metadata.file_path").alias("file"), name.alias("name"), "value")
        ours = [r["head"] for r in rows]
        if len(layouts) > 1:  # a line is looked into only once its file's header is known
            of_file = first.groupBy("file").agg(F.min_by("value", "line").alias("head"))
            mine = mine.join(of_file, "file").withColumn("value", F.when(F.col("head").isin(*ours), F.col("value")))
        mine = mine.filter(~F.col("value").isin(*ours) & (F.trim("value") != ""))
        c = F.from_csv("value", kind)
        part = mine.select(F.regexp_extract("name", r"^(.*)\.csv$", 1).alias("name"), c.alias("c"))
        at = lambda x, head=head: F.col(f"c.c{head.index(x)}")
        part = part.select(F.url_decode(F.regexp_replace("name", r"\+", "%2B")).alias("ticker"), F.to_timestamp(at("timestamp")).alias("ts"), at("close").try_cast("double").alias("close"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "ticker string, ts timestamp, close double")


def read_wide_parquet(spark: SparkSession, path: str, ticker: str = "tr_ric") -> DataFrame:
    return spark.read.parquet(path).select(F.col(ticker).alias("ticker"), F.col("timestamp").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close"))


def first_seen(spark: SparkSession, path: str, ticker: str = "tr_ric") -> DataFrame:
    """(ticker, place): where each ticker first stands in the Parquet files, as file and row number; sorts as the rows stand."""
    rows = spark.read.parquet(path).select(F.col(ticker).alias("ticker"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))
    return rows.groupBy("ticker").agg(F.min("place").alias("place"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Path form, values in double precision."""
    raw = spark.read.parquet(path)
    return raw.select("path_id", "ticker", "regime", F.col("values").cast("array<double>").alias("values")).to(CORPUS)


def read_npy_corpus(spark: SparkSession, path: str, tickers: str | None = None, regimes: str | None = None) -> DataFrame:
    """Path form from .npy arrays (N, T) or (N, T, 1), and label arrays of the same length; arrays go to Spark as Arrow, not as Python values."""
    import numpy as np
    import pyarrow as pa

    x = np.load(path, mmap_mode="r")
    if x.ndim == 3 and x.shape[2] == 1:
        x = x[:, :, 0]
    if x.ndim != 2:
        raise ValueError(f"{path}: (N, T) or (N, T, 1) wanted, got {x.shape}")
    n, t = x.shape
    name, regime = (np.load(p) if p else None for p in (tickers, regimes))
    if any(v is not None and len(v) != n for v in (name, regime)):
        raise ValueError("labels and paths differ in number")
    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * t), pa.array(np.asarray(x, np.float64).ravel()))
    label = pa.nulls(n, pa.string()) if name is None else pa.array([str(v) for v in name.tolist()], pa.string())
    group = pa.nulls(n, pa.int8()) if regime is None else pa.array(regime.astype(np.int8))
    rows = pa.table([pa.array(np.arange(n)), label, group, values], ["path_id", "ticker", "regime", "values"])
    return spark.createDataFrame(rows, CORPUS)


def read_curve(spark: SparkSession, path: str, day: int = 390) -> DataFrame:
    curve = spark.read.parquet(path).select(F.col("tau").cast("int"), F.col("s").cast("double"))
    if (n := curve.count()) != day:
        raise ValueError(f"{path}: {n} minutes, not {day}")
    return curve


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest, or None if there is none at ``path``."""
    if not exists(spark, path):
        return None
    return spark.read.schema(MANIFEST).json(path, multiLine=True).first().asDict()


def read_split(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(SPLIT).json(path, multiLine=True)
    return raw.select(F.explode(F.map_from_arrays(F.array(F.lit("train"), F.lit("eval")), F.array("train", "eval"))).alias("side", "t")).select(F.explode("t").alias("ticker"), "side")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Liquidity statistics from CSV; an empty or null-like ticker stays as it is written."""
    kinds = "ticker string, median_bars_per_day double, trading_days long, total_returns long, liquidity_class string"
    return spark.read.option("header", True).option("nullValue", "\u0000").schema(kinds).csv(path)


def dumps(value: dict) -> str:
    return json.dumps(value, indent=2)
