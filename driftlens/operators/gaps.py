"""The six gaps between two corpora, as DataFrames.

Corpora come in long form (side, path_id, t, r) with two sides, 'a' and 'b', or as ``two`` makes them. Every gap is one
row with a column ``gap``; the parts it is made of (curves, blocks, correlations, thresholds) are operators too.
``pos`` may stand beside path_id where a path is drawn more than once: then it identifies the path. B2 and B3 also take
path form, (side, path_id, values), which spares them a shuffle. What comes back is a row or a few, worked out when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order

STD_LEAST = 1e-10
VAR_LEAST = 1e-8
BLOCKS_LEAST = 30
EXCEED_LEAST = 50
#: Values whose transforms are in memory at once.
FFT_VALUES = 1 << 18


def two(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


def _difference(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., a, b) of the two sides' values."""
    one = lambda s: F.max(F.when(F.col("side") == s, F.col(value))).alias(s)
    return rows.groupBy(*key).agg(one("a"), one("b"))


# B1: tail quantiles


def tail_points(tail: float = 0.05, grid: int = 1000) -> list[float]:
    if not 0 < tail < 0.5 or grid < 100:
        raise ValueError("tail must be in (0, 0.5) and the grid at least 100")
    mid = [(i + 0.5) / grid for i in range(grid)]
    return [u for u in mid if u < tail or u > 1 - tail]


def b1_gap(long: DataFrame, tail: float = 0.05, grid: int = 1000) -> DataFrame:
    q = order.quantiles(long, "r", tail_points(tail, grid), ["side"])
    return _difference(q, ["p"], "q").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("gap"))


# B2, B3: lagged moments of a path


def lag_curves(long: DataFrame, lags: range, leverage: bool = False) -> DataFrame:
    """(side, path_id, lag, c): autocorrelation of |r|, or correlation of r with later |r|; both over n, biased.

    A path whose spread is below STD_LEAST has zeros. Lags not below the length have null. The path's series is
    centred once; each lag is a sum of products over the array, so no row pairs are made.
    """
    key = ["side", "path_id"]
    paths = long.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "r"))).alias("v"))
    paths = paths.select(*key, F.transform("v", lambda x: x["r"]).alias("r"), F.transform("v", lambda x: F.abs(x["r"])).alias("m"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    paths = paths.withColumns({"_mr": mean("r"), "_mm": mean("m")})
    paths = paths.select(*key, F.expr("transform(r, x -> x - _mr)").alias("r"), F.expr("transform(m, x -> x - _mm)").alias("m"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    paths = paths.withColumns({"_r2": square("r"), "_m2": square("m"), "n": F.size("r")})
    first = "r" if leverage else "m"
    scale = F.sqrt(F.col("_r2") * F.col("_m2")) if leverage else F.col("_m2")
    least = F.lit(STD_LEAST**2) * F.col("n")
    flat = (F.col("_m2") < least) | ((F.col("_r2") < least) if leverage else F.lit(False))
    rows = paths.withColumn("lag", F.explode(F.sequence(F.lit(lags.start), F.lit(lags.stop - 1)))).withColumns({"_scale": scale, "_flat": flat})
    product = F.expr(f"aggregate(zip_with(slice({first}, 1, greatest(n - lag, 0)), slice(m, lag + 1, greatest(n - lag, 0)), (x, y) -> x * y), 0D, (s, x) -> s + x)")
    c = F.when(F.col("lag") >= F.col("n"), F.lit(None)).when(F.col("_flat"), F.lit(0.0)).otherwise(F.try_divide(product, F.col("_scale")))
    return rows.select(*key, "lag", c.alias("c"))


def mean_curves(curves: DataFrame) -> DataFrame:
    return curves.groupBy("side", "lag").agg(F.avg("c").alias("c"))


def curve_gap(curves: DataFrame) -> DataFrame:
    return _gap_of(mean_curves(curves))


def _gap_of(means: DataFrame) -> DataFrame:
    return _difference(means, ["lag"], "c").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("gap"))


def b2_gap(rows: DataFrame, lags: range = range(60, 391)) -> DataFrame:
    return _gap_of(fast_mean_curves(rows, lags))


def b3_gap(rows: DataFrame, lags: range = range(1, 391)) -> DataFrame:
    return _gap_of(fast_mean_curves(rows, lags, leverage=True))


def _arrays(rows: DataFrame) -> DataFrame:
    """(side, path_id, v): a path's returns in order, from long or path form."""
    if "values" in rows.columns:
        return rows.select("side", "path_id", F.col("values").alias("v"))
    paths = rows.groupBy("side", "path_id").agg(F.array_sort(F.collect_list(F.struct("t", "r"))).alias("v"))
    return paths.select("side", "path_id", F.transform("v", lambda x: x["r"]).alias("v"))


def _stacked(batch, lags: range, leverage: bool):
    """(rows of the batch, their curves) for the paths of each length: one transform for all of a length."""
    import numpy as np

    from ..functions import kernels

    v = batch.column("v")
    size = np.asarray(v.value_lengths().fill_null(0))
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        for lo in range(0, len(at), max(1, FFT_VALUES // int(n))):
            some = at[lo : lo + max(1, FFT_VALUES // int(n))]
            x = v.take(some).flatten().to_numpy(zero_copy_only=False).reshape(len(some), n)
            yield some, kernels.lag_curve(x, lags.start, lags.stop - 1, leverage)


def fast_curves(rows: DataFrame, lags: range, leverage: bool = False) -> DataFrame:
    """lag_curves by FFT, many paths at a time: for many lags of long paths."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            for some, c in _stacked(batch, lags, leverage):
                many = pa.array(np.repeat(some, len(lags)))
                yield pa.RecordBatch.from_arrays([batch.column("side").take(many), batch.column("path_id").cast(pa.int64()).take(many), pa.array(np.tile(np.array(lags, np.int32), len(some))), pa.array(c.ravel(), from_pandas=True)], ["side", "path_id", "lag", "c"])

    return _arrays(rows).mapInArrow(run, "side string, path_id long, lag int, c double")


def fast_mean_curves(rows: DataFrame, lags: range, leverage: bool = False) -> DataFrame:
    """mean_curves of fast_curves: a batch of paths sends sums, a row per side and lag, not one per path and lag."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            sides, which = np.unique(np.array(batch.column("side").to_pylist(), object), return_inverse=True) if batch.num_rows else ([], None)
            total, n = np.zeros((len(sides), len(lags))), np.zeros((len(sides), len(lags)), np.int64)
            for some, c in _stacked(batch, lags, leverage):
                np.add.at(total, which[some], np.nan_to_num(c))
                np.add.at(n, which[some], ~np.isnan(c))
            if len(sides):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sides, len(lags)), pa.string()), pa.array(np.tile(np.array(lags, np.int32), len(sides))), pa.array(total.ravel()), pa.array(n.ravel())], ["side", "lag", "s", "n"])

    sums = _arrays(rows).mapInArrow(run, "side string, lag int, s double, n long").groupBy("side", "lag").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("side", "lag", F.try_divide("s", "n").alias("c"))


# B4: L-kurtosis of block sums


def block_sums(long: DataFrame, h: int, length: int, pos: str = "path_id") -> DataFrame:
    """(side, block, x): sums of h returns in a row over the pooled vector of a side, paths in order of ``pos``; the rest goes.

    Blocks run over path boundaries where h doesn't divide the length, so the order of paths matters there. ``pos``
    need not be dense: positions are numbered first, by exact ranks over one row per path.
    """
    seat = order.ranked(long.select("side", pos).distinct(), pos, ["side"]).select("side", pos, F.col("rank").alias("_seat"))
    at = long.join(seat, ["side", pos]).withColumn("block", F.floor((F.col("_seat") * length + F.col("t")) / h))
    return at.groupBy("side", "block").agg(F.sum("r").alias("x"), F.count("*").alias("_k")).filter(F.col("_k") == h).drop("_k")


def l_kurtosis(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, tau4): unbiased fourth L-moment ratio; null below 4 values or where the second L-moment vanishes.

    The weight of rank j in the k-th moment is j (j - 1) ... over the same of n - 1, and is added up over the ranks of equal
    values, so equal values are one row.
    """
    x = order.ranked(rows, value, by)
    a, c, n = (F.col(k).cast("double") for k in ("rank", "_c", "n"))
    down = lambda x, k: F.lit(1.0) if k == 0 else down(x, k - 1) * (x - (k - 1))  # noqa: E731  a product of k factors
    # by Vandermonde's identity; no differences of large numbers
    over = [F.lit(1.0), a + down(c - 1, 1) / 2, down(a, 2) + a * (c - 1) + down(c - 1, 2) / 3, down(a, 3) + down(a, 2) * (c - 1) * 1.5 + a * down(c - 1, 2) + down(c - 1, 3) / 4]
    weights = lambda k: F.try_divide(c * over[k], down(n - 1, k))
    sums = x.groupBy(*by).agg(F.first("n").alias("n"), *[F.sum(weights(k) * F.col(value)).alias(f"b{k}") for k in range(4)])
    sums = sums.withColumns({f"b{k}": F.col(f"b{k}") / F.col("n") for k in range(4)})
    l2, l4 = F.expr("2 * b1 - b0"), F.expr("20 * b3 - 30 * b2 + 12 * b1 - b0")
    return sums.select(*by, "n", F.when((F.col("n") >= 4) & (F.abs(l2) >= 1e-12), F.try_divide(l4, l2)).alias("tau4"))


def _few(rows: DataFrame, *kept: DataFrame) -> DataFrame:
    """A result of a few rows, worked out now; what was kept for it is freed."""
    found = rows.collect()
    for x in kept:
        x.unpersist()
    return rows.sparkSession.createDataFrame(found, rows.schema)


def b4_gap(long: DataFrame, length: int, horizons: tuple[int, ...] = (1, 5, 30, 60, 390), weights: tuple[float, ...] | None = None, pos: str = "path_id") -> DataFrame:
    weights = weights or tuple(1.0 / h for h in horizons)
    if len(weights) != len(horizons):
        raise ValueError("as many weights as horizons are needed")
    blocks = None
    for h in horizons:
        b = block_sums(long, h, length, pos).withColumn("h", F.lit(h))
        blocks = b if blocks is None else blocks.unionByName(b)
    blocks = blocks.persist()  # read by three passes
    tau = l_kurtosis(blocks, "x", ["h", "side"]).filter(F.col("n") >= BLOCKS_LEAST)
    w = F.coalesce(*[F.when(F.col("h") == h, F.lit(float(x))) for h, x in zip(horizons, weights, strict=True)])
    both = _difference(tau, ["h"], "tau4").filter("a is not null and b is not null")
    return _few(both.agg(F.try_divide(F.sum(w * F.abs(F.col("a") - F.col("b"))), F.sum(w)).alias("gap")), blocks)


# B5: correlations of volatility across scales


def scale_correlations(long: DataFrame, scales: tuple[int, ...]) -> DataFrame:
    """(side, path_id, i, j, c), i < j: correlation over time of the root mean squares of the last scales[i] and [j] returns.

    All scales run over the same times, those where the largest is full. Paths with a flat volatility at any scale go.
    """
    key, top = ["side", "path_id"], max(scales)
    w = W.partitionBy(*key).orderBy("t")
    vols = long.select(*key, "t", *[F.sqrt(F.avg(F.col("r") * F.col("r")).over(w.rowsBetween(1 - s, 0))).alias(f"v{s}") for s in scales])
    vols = vols.filter(F.col("t") >= top - 1)
    pairs = [(i, j) for i in range(len(scales)) for j in range(i + 1, len(scales))]
    v = lambda i: f"v{scales[i]}"
    stats = vols.groupBy(*key).agg(
        F.count("*").alias("n"),
        *[F.var_pop(v(i)).alias(f"s{i}") for i in range(len(scales))],
        *[F.covar_pop(v(i), v(j)).alias(f"c{i}_{j}") for i, j in pairs],
    )
    for i in range(len(scales)):
        stats = stats.filter(F.col(f"s{i}") * F.col("n") > VAR_LEAST)
    c = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"c{i}_{j}") / F.sqrt(F.col(f"s{i}") * F.col(f"s{j}"))).alias("c")) for i, j in pairs]))
    return stats.select(*key, c.alias("p")).select(*key, "p.i", "p.j", "p.c")


def b5_gap(long: DataFrame, scales: tuple[int, ...] = (5, 20, 60, 120)) -> DataFrame:
    """Frobenius norm of the difference of the sides' mean correlation matrices; null if a side has no sound path."""
    mean = scale_correlations(long, scales).groupBy("side", "i", "j").agg(F.avg("c").alias("c"))
    return _difference(mean, ["i", "j"], "c").agg(F.sqrt(2 * F.sum(F.pow(F.col("a") - F.col("b"), 2))).alias("gap"))


# B6: tail index by volatility regime


def with_volatility(long: DataFrame, lookback: int = 60) -> DataFrame:
    """Rows from t = lookback on, with vol: sample standard deviation of the ``lookback`` returns before."""
    w = W.partitionBy("side", "path_id").orderBy("t").rowsBetween(-lookback, -1)
    return long.withColumn("vol", F.stddev_samp("r").over(w)).filter(F.col("t") >= lookback)


def regime_thresholds(vols: DataFrame, regimes: int = 3) -> DataFrame:
    """(p, q): the volatility quantiles that bound the regimes."""
    return order.quantiles(vols.withColumn("_all", F.lit(1)), "vol", [i / regimes for i in range(1, regimes)], ["_all"]).drop("_all")


def in_regime(vols: DataFrame, bounds: list[float]) -> DataFrame:
    """Adds regime: how many of the sorted bounds the volatility reaches."""
    at: Column = F.lit(0)
    for b in bounds:
        at = at + (F.col("vol") >= b).cast("int")
    return vols.withColumn("regime", at)


def exceedances(rows: DataFrame, tail: float = 0.05) -> DataFrame:
    """(side, regime, e): |r| above its (1 - tail) quantile of the side and regime, less it."""
    x = rows.withColumn("m", F.abs("r"))
    u = order.quantiles(x, "m", [1 - tail], ["side", "regime"]).select("side", "regime", F.col("q").alias("u"))
    return x.join(F.broadcast(u), ["side", "regime"]).filter("m > u").select("side", "regime", (F.col("m") - F.col("u")).alias("e"))


def tail_indices(exceed: DataFrame) -> DataFrame:
    """(side, regime, n, xi): generalised Pareto shape by maximum likelihood; null below EXCEED_LEAST exceedances.

    The profile likelihood of theta = xi / sigma needs the exceedances only in mean(log1p(theta * e)), so every exceedance counts
    at any size: a pass adds that up for a grid of thetas, and each later one for a finer grid around the best.
    Groups are sides times regimes, so what comes to the driver are a few sums of a grid.
    """
    from ..functions import kernels

    spark, exceed = exceed.sparkSession, exceed.select("side", F.col("regime").cast("int").alias("regime"), "e").persist()  # read by each pass
    found = exceed.groupBy("side", "regime").agg(F.count("*").alias("n"), F.max("e").alias("top"), F.avg("e").alias("mean")).collect()
    grids = {(g.side, g.regime): kernels.theta_grid(g.top, g.mean) for g in found if g.n >= EXCEED_LEAST and g.top > 0}
    best: dict = {}
    for turn in range(GRID_TURNS):
        if not grids:
            break
        shapes = _mean_logs(exceed, grids)
        for g in found:
            key = (g.side, g.regime)
            if key in grids:
                best[key], grids[key] = kernels.narrowed(grids[key], shapes[key], g["mean"], turn == 0)
    exceed.unpersist()
    return spark.createDataFrame([(g.side, g.regime, g.n, best.get((g.side, g.regime))) for g in found], "side string, regime int, n long, xi double")


#: Passes of ``tail_indices``: the first over the whole range of theta, each later one a finer grid between two neighbours.
GRID_TURNS = 6


def _mean_logs(exceed: DataFrame, grids: dict) -> dict:
    """Per (side, regime) the mean of log1p(theta * e) over its exceedances, for each theta of its grid."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        sums = {k: np.zeros(len(g) + 1) for k, g in grids.items()}
        for batch in batches:
            e, regime = batch.column("e").to_numpy(), batch.column("regime").to_numpy()
            side = np.array(batch.column("side").to_pylist(), object)
            for (s, r), grid in grids.items():
                x = e[(side == s) & (regime == r)]
                for lo in range(0, len(x), 4096):
                    sums[s, r][:-1] += np.log1p(np.multiply.outer(grid, x[lo : lo + 4096])).sum(axis=1)
                sums[s, r][-1] += len(x)
        rows = [(s, r, i, float(v)) for (s, r), total in sums.items() if total[-1] for i, v in enumerate(total)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["side", "regime", "i", "s"])

    rows = exceed.mapInArrow(run, "side string, regime int, i int, s double").groupBy("side", "regime", "i").agg(F.sum("s").alias("s")).collect()
    out = {k: np.zeros(len(g) + 1) for k, g in grids.items()}
    for x in rows:
        out[x.side, x.regime][x.i] = x.s
    return {k: v[:-1] / v[-1] for k, v in out.items()}


def b6_gap(long: DataFrame, regimes: int = 3, tail: float = 0.05, lookback: int = 60, bounds: list[float] | None = None) -> DataFrame:
    """Mean difference of tail indices over the regimes both sides have; bounds default to side a's volatility quantiles.

    The volatilities are read by several passes, so they are kept (in memory, or else on disk) until the gap is known.
    """
    vols = with_volatility(long, lookback).persist()
    if bounds is None:
        bounds = [x.q for x in regime_thresholds(vols.filter("side = 'a'"), regimes).orderBy("p").collect()]  # regimes - 1 rows
    xi = tail_indices(exceedances(in_regime(vols, bounds), tail))
    vols.unpersist()
    both = _difference(xi, ["regime"], "xi").filter("a is not null and b is not null")
    return both.agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("gap"))
