"""Intraday seasonality: Fourier fit by aggregated normal equations, deseasonalising, z-scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DAY, HARMONICS, SESSION

FLOOR = 1e-8


def tau_profile(returns: DataFrame, open_minute: int = SESSION[0]) -> DataFrame:
    """Mean absolute return at each minute since the open: a row per tau, at most a day's minutes."""
    return returns.groupBy((F.col("minute_of_day") - open_minute).alias("tau")).agg(F.avg(F.abs("log_return")).alias("mean_abs_return"), F.count("*").alias("n"))


def basis(tau: Column, harmonics: int = HARMONICS, day: int = DAY) -> list[Column]:
    angle = lambda j: 2 * np.pi * j * tau / day
    return [F.lit(1.0), *[f(angle(j)) for j in range(1, harmonics + 1) for f in (F.cos, F.sin)]]


def normal_sums(profile: DataFrame, harmonics: int = HARMONICS, day: int = DAY) -> DataFrame:
    """One row: m_i_j, the sums of products of basis functions (i <= j), and v_i, those with the profile."""
    b = basis(F.col("tau"), harmonics, day)
    moments = [F.sum(b[i] * b[j]).alias(f"m_{i}_{j}") for i in range(len(b)) for j in range(i, len(b))]
    return profile.agg(*moments, *[F.sum(x * F.col("mean_abs_return")).alias(f"v_{i}") for i, x in enumerate(b)])


def fit_curve(profile: DataFrame, harmonics: int = HARMONICS, day: int = DAY) -> DataFrame:
    """(tau, s) for every minute of the day. The model is linear, so its least squares need one row of sums."""
    row, k = normal_sums(profile, harmonics, day).first(), 1 + 2 * harmonics
    m = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    v = np.array([row[f"v_{i}"] or 0.0 for i in range(k)])
    if np.linalg.matrix_rank(m) < k:
        raise ValueError(f"the profile needs at least {k} different minutes")
    w = np.linalg.solve(m, v)
    spark = profile.sparkSession
    b = basis(F.col("tau"), harmonics, day)
    s = sum((F.lit(float(c)) * x for c, x in zip(w, b, strict=True)), F.lit(0.0))
    return spark.range(day).select(F.col("id").cast("int").alias("tau")).withColumn("s", F.greatest(s, F.lit(FLOOR)))


def deseasonalise(returns: DataFrame, curve: DataFrame, open_minute: int = SESSION[0]) -> DataFrame:
    """Adds return_deseas. The curve has at most a row per minute of a day, so it is broadcast."""
    keyed = returns.withColumn("tau", F.col("minute_of_day") - open_minute)
    return keyed.join(F.broadcast(curve.select("tau", "s")), "tau").withColumn("return_deseas", F.col("log_return") / F.col("s")).drop("s", "tau")


def norm_stats(returns: DataFrame, value: str = "return_deseas") -> DataFrame:
    """Per ticker mean and std (one degree of freedom less), std at least FLOOR; null for a single return."""
    sd = F.stddev_samp(value)
    return returns.groupBy("ticker").agg(F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.greatest(sd, F.lit(FLOOR))).alias("std"))


def normalise(returns: DataFrame, stats: DataFrame, value: str = "return_deseas") -> DataFrame:
    return returns.join(stats.select("ticker", "mean", "std"), "ticker").withColumn("return_normed", (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")
