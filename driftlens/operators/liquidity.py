"""Liquidity statistics, tiers, and the split of tickers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import HOLDOUT, SEED, TIERS


def liquidity(returns: DataFrame) -> DataFrame:
    """Per ticker: median_bars_per_day over days that have returns, trading_days, total_returns."""
    days = returns.groupBy("ticker", "date_ny").agg(F.count("*").alias("n"))
    return days.groupBy("ticker").agg(F.percentile("n", F.lit(0.5)).alias("median_bars_per_day"), F.count("*").alias("trading_days"), F.sum("n").alias("total_returns"))


def classify(stats: DataFrame, tiers: dict[str, float] | None = None) -> DataFrame:
    """Adds liquidity_class: the highest tier whose threshold the median reaches, else excluded."""
    out = F.lit("excluded")
    for name, least in sorted((tiers or TIERS).items(), key=lambda x: x[1]):
        out = F.when(F.col("median_bars_per_day") >= least, F.lit(name)).otherwise(out)
    return stats.withColumn("liquidity_class", out)


def split_names(eligible: list[str], train_only: list[str], holdout: float = HOLDOUT, seed: int = SEED) -> dict[str, list[str]]:
    """Names to sides by NumPy's generator, so that it agrees draw for draw with the published split."""
    names = np.array(sorted(eligible))
    np.random.default_rng(seed).shuffle(names)
    cut = max(1, round(len(names) * holdout)) if len(names) else 0
    return {"train": sorted([*names[cut:].tolist(), *train_only]), "eval": sorted(names[:cut].tolist())}


def ticker_split(classed: DataFrame, holdout: float = HOLDOUT, seed: int = SEED) -> DataFrame:
    """(ticker, side). Ticker names, not rows, come to the driver: a bounded listing of instruments."""
    names = {k: [] for k in ("eval_eligible", "train_only")}
    for r in classed.filter(F.col("liquidity_class").isin(*names)).select("ticker", "liquidity_class").toLocalIterator():
        names[r.liquidity_class].append(r.ticker)
    split = split_names(names["eval_eligible"], names["train_only"], holdout, seed)
    return classed.sparkSession.createDataFrame([(t, side) for side, ts in split.items() for t in ts], "ticker string, side string")


def side(rows: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """The rows of one side's tickers."""
    return rows.join(split.filter(F.col("side") == name).select("ticker"), "ticker", "left_semi")
