"""Exact ranks and quantiles without a single-task sort.

Equal values are counted first, so a value that a third of the rows has is one row. Distinct values fall into monotone bins
(finer towards zero, so heavy tails don't crowd one bin), in number with the values there are. Counts of the bins
combine on the map side; a prefix sum over them gives each bin's first rank, and values are sorted within a bin.
Quantiles sort only the bins that hold a wanted rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least and most bins of a group, and the values for which one is added between; the most are what one task adds up.
BINS, MOST_BINS, BIN_ROWS = 4096, 1 << 20, 20_000


def binned(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds _bin. Needs two passes: the first for the number, scale and range of each group."""
    scale = rows.groupBy(*by).agg(F.avg(F.abs(value)).alias("_a"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_m"))
    squash = lambda x: F.signum(x) * F.log1p(F.abs(x) / F.greatest(F.col("_a"), F.lit(1e-300)))
    low, high = squash(F.col("_lo")), squash(F.col("_hi"))
    bins = F.least(F.lit(MOST_BINS), F.greatest(F.lit(BINS), F.expr(f"_m div {BIN_ROWS}")))
    place = F.when(high > low, F.floor((squash(F.col(value)) - low) / (high - low) * bins)).otherwise(F.lit(0))
    return rows.join(scale, by).withColumn("_bin", F.greatest(F.lit(0), F.least(bins - 1, place)).cast("int")).drop("_a", "_lo", "_hi", "_m")


def counted(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value, _c): each value that is not null, and how many rows have it."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))


def _bases(rows: DataFrame, by: list[str]) -> DataFrame:
    counts = rows.groupBy(*by, "_bin").agg(F.sum("_c").alias("_n"))
    w = W.partitionBy(*by)
    return counts.withColumn("_base", F.sum("_n").over(w.orderBy("_bin")) - F.col("_n")).withColumn("n", F.sum("_n").over(w))


def ranked(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value, _c, rank, n): each value with its first rank (from 0), the rows that have it and those of the group."""
    b = binned(counted(rows, value, by), value, by)
    within = F.sum("_c").over(W.partitionBy(*by, "_bin").orderBy(value)) - F.col("_c")
    return b.join(_bases(b, by).drop("_n"), [*by, "_bin"]).withColumn("rank", F.col("_base") + within).drop("_bin", "_base")


def quantiles(rows: DataFrame, value: str, probs: list[float], by: list[str]) -> DataFrame:
    """(by..., p, q): exact quantiles with linear interpolation."""
    b = binned(counted(rows, value, by), value, by)
    bases = _bases(b, by)
    points = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    want = bases.select(*by, "n").distinct().withColumn("p", points).withColumn("_h", (F.col("n") - 1) * F.col("p"))
    want = want.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
    want = want.drop("n").join(bases, by).filter("_r >= _base and _r < _base + _n").withColumn("_k", F.col("_r") - F.col("_base"))
    bins = want.select(*by, "_bin").distinct()
    few = b.join(F.broadcast(bins), [*by, "_bin"], "left_semi")  # at most two bins a point and group
    few = few.withColumn("_first", F.sum("_c").over(W.partitionBy(*by, "_bin").orderBy(value)) - F.col("_c"))
    hit = want.join(few, [*by, "_bin"]).filter("_k >= _first and _k < _first + _c")
    low, high = F.min(value), F.max(value)
    return hit.groupBy(*by, "p").agg((low + (high - low) * (F.first("_h") - F.floor(F.first("_h")))).alias("q"))
