"""Corpora of fixed-length paths: windows, labels, splits, alignment, validation.

Path form: (path_id, ticker, regime, values array<double>), a row per path. Long form: (path_id, ticker, regime, t, r).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import CRASH, SEED, STD_TOLERANCE, WINDOW


def windows(rows: DataFrame, value: str, length: int = WINDOW, by: tuple[str, ...] = ("ts",), date: str | None = "date_ny", cutoff: str = CRASH, places: DataFrame | None = None) -> DataFrame:
    """Path form: whole, non-overlapping runs of ``length`` returns of each ticker in order; what is left over goes.

    path_id counts from 0 by ticker and window; tickers go by name, or by ``places`` (ticker, place). Numbering is over one row per ticker (its count of windows), not over
    the paths. regime is 0 for windows that begin before ``cutoff``, else 1.
    """
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy("ticker").orderBy(*by)) - 1)
    numbered = numbered.withColumn("win", F.floor(F.col("_n") / length)).withColumn("t", (F.col("_n") % length).cast("int"))
    began = F.min_by(date, "t") if date else F.lit(None).cast("date")
    found = numbered.groupBy("ticker", "win").agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("r")))).alias("_v"), began.alias("_d"))
    found = found.filter(F.size("_v") == length)
    per = found.groupBy("ticker").agg(F.count("*").alias("_k"))
    per = per.withColumn("place", F.col("ticker")) if places is None else per.join(places.select("ticker", "place"), "ticker")
    base = per.select("ticker", F.coalesce(F.sum("_k").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    out = found.join(base, "ticker").withColumn("path_id", (F.col("_base") + F.col("win")).cast("long"))
    regime = F.when(F.col("_d") < F.lit(cutoff).cast("date"), 0).when(F.col("_d").isNotNull(), 1).cast("byte")
    return out.select("path_id", "ticker", regime.alias("regime"), F.transform("_v", lambda x: x["r"]).alias("values"))


def to_long(corpus: DataFrame, *keep: str) -> DataFrame:
    keep = keep or tuple(c for c in corpus.columns if c != "values")
    return corpus.select(*keep, F.posexplode("values").alias("t", "r"))


def to_paths(long: DataFrame, *keys: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("t", "r")))
    return long.groupBy(*keys).agg(F.transform(rows, lambda x: x["r"]).alias("values"))


def train_val(corpus: DataFrame, share: float = 0.10) -> DataFrame:
    """Adds is_val: the last max(1, round half to even of share) windows of each ticker with more than one."""
    w = W.partitionBy("ticker")
    n = F.count("*").over(w)
    last = F.row_number().over(w.orderBy(F.col("path_id").desc()))
    return corpus.withColumn("is_val", (n > 1) & (last <= F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("long"))))


def pooled_stats(corpus: DataFrame) -> DataFrame:
    """One row: n paths, window_len (least and most), mean and std (population) of all values, count of non-finite ones."""
    long = corpus.select(F.explode("values").alias("r"))
    odd = F.col("r").isNull() | F.isnan("r") | (F.abs("r") == float("inf"))
    values = long.agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.count_if(odd).alias("non_finite"))
    shape = corpus.agg(F.count("*").alias("n"), F.min(F.size("values")).alias("least_len"), F.max(F.size("values")).alias("most_len"))
    return shape.crossJoin(values)  # one row each


def validate(corpus: DataFrame, name: str, window_len: int, reference_std: float, tolerance: float = STD_TOLERANCE) -> dict:
    """The pooled statistics; an error for another length or non-finite values, ``warning`` if std strays too far."""
    s = pooled_stats(corpus).first()
    if not s.n or (s.least_len, s.most_len) != (window_len, window_len):
        raise ValueError(f"{name}: paths of {s.least_len} to {s.most_len} values, not {window_len}")
    if s.non_finite:
        raise ValueError(f"{name}: {s.non_finite} non-finite values")
    rel = abs(s["std"] - reference_std) / max(reference_std, 1e-12)
    return {"n": s.n, "mean": s["mean"], "std": s["std"], "warning": rel > tolerance, "relative": rel}


def corpus_line(name: str, stats: dict) -> str:
    return f"  {name:<8} n={stats['n']:>4}  mean={stats['mean']:+.5f}  std={stats['std']:.4f}"


def subsample(corpus: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``n`` paths drawn by NumPy's generator without replacement, as rows with ``pos`` in the order drawn."""
    have = corpus.count()
    if have < n:
        raise ValueError(f"{n} paths wanted, {have} there")
    at = np.random.default_rng(seed).choice(have, size=n, replace=False)
    drawn = corpus.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(at)], "pos int, path_id long")
    return corpus.join(drawn, "path_id")


def align(corpus: DataFrame, reference_std: float, scale: bool = True) -> DataFrame:
    """Values minus their pooled mean, and with ``scale`` times reference_std / std where std > 1e-12."""
    s = corpus.select(F.explode("values").alias("r")).agg(F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s"))
    factor = F.when(F.lit(scale) & (F.col("_s") > 1e-12), F.lit(reference_std) / F.col("_s")).otherwise(1.0)
    out = corpus.crossJoin(F.broadcast(s))  # one row
    return out.withColumn("_f", factor).withColumn("values", F.expr("transform(values, x -> (x - _m) * _f)")).drop("_m", "_s", "_f")


def prepare(corpus: DataFrame, window_len: int, reference_std: float, n: int, seed: int = SEED, scale: bool = True) -> DataFrame:
    """Subsample, align, check."""
    out = align(subsample(corpus, n, seed), reference_std, scale)
    s = pooled_stats(out).first()
    if (s.least_len, s.most_len) != (window_len, window_len):
        raise ValueError(f"paths of {s.least_len} to {s.most_len} values, not {window_len}")
    if s.non_finite:
        raise ValueError("non-finite values in corpus")
    return out


def label_counts(corpus: DataFrame) -> DataFrame:
    """Per regime: windows and distinct tickers."""
    return corpus.groupBy("regime").agg(F.count("*").alias("windows"), F.countDistinct("ticker").alias("tickers"))
