"""Matched-size resampling, similarity scores with bootstrap intervals, composites and ranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import gaps
from ..operators.corpus import to_long
from ..schemas import BOOTSTRAP, PATHS, RESAMPLES, SEED
from .samplers import PooledSampler, Sampler, paired_draws, unpaired_draws

Gap = Callable[[np.ndarray, np.ndarray], float]
Feature = Callable[[np.ndarray], np.ndarray]


class Bucket:
    """A gap: ``feature`` maps paths (n, T) to rows (n, k) that no draw changes, ``gap`` compares two draws of those."""

    def __init__(self, name: str, description: str, gap: Gap, feature: Feature | None = None):
        self.name, self.description, self.gap, self.feature = name, description, gap, feature

    def compute_gap(self, a: np.ndarray, b: np.ndarray) -> float:
        for x in (a, b):
            if x.ndim != 2 or not x.size or not np.isfinite(x).all():
                raise ValueError("paths must be a non-empty matrix of finite values")
        return self.gap(*((self.feature(x) for x in (a, b)) if self.feature else (a, b)))

    def fit(self, real: DataFrame) -> Bucket:
        return self


def lag_bucket(name: str, description: str, k_min: int, k_max: int, leverage: bool) -> Bucket:
    if k_min < 1 or k_max <= k_min:
        raise ValueError("lags must be 1 <= k_min < k_max")
    return Bucket(name, description, kernels.curve_gap, lambda x: kernels.lag_curve(x, k_min, k_max, leverage))


class TailRegime(Bucket):
    """Thresholds come from the whole real corpus once ``fit``, else from the first side."""

    def __init__(self, regimes: int = 3, tail: float = 0.05, lookback: int = 60, bounds: list[float] | None = None):
        self.regimes, self.tail, self.lookback, self.bounds = regimes, tail, lookback, bounds
        super().__init__("B6", "tail index by volatility regime", self._gap)

    def _gap(self, a, b):
        a, b = (kernels.rolling_vol(x, self.lookback) for x in (a, b))
        if self.bounds is None and not len(a[1]):
            return float("nan")
        bounds = self.bounds if self.bounds is not None else [float(np.quantile(a[1], i / self.regimes)) for i in range(1, self.regimes)]
        return kernels.tail_regime_gap(a, b, bounds, self.tail)

    def fit(self, real: DataFrame) -> Bucket:
        long = to_long(real, "path_id").withColumn("side", F.lit("a"))
        rows = gaps.regime_thresholds(gaps.with_volatility(long, self.lookback), self.regimes).orderBy("p").collect()
        if len(rows) < self.regimes - 1:
            raise ValueError("the real corpus is too small for volatility regimes")
        return TailRegime(self.regimes, self.tail, self.lookback, [r.q for r in rows])


def buckets(k2=(60, 390), k3=(1, 390), horizons=(1, 5, 30, 60, 390), scales=(5, 20, 60, 120), lookback: int = 60) -> list[Bucket]:
    """All six, in the order in which seeds are dealt."""
    k = len(scales)
    return [
        Bucket("B1", "tail quantiles", kernels.tail_gap),
        lag_bucket("B2", "autocorrelation of |r|", *k2, leverage=False),
        lag_bucket("B3", "leverage", *k3, leverage=True),
        Bucket("B4", "L-kurtosis over horizons", lambda a, b: kernels.kurtosis_gap(a, b, horizons)),
        Bucket("B5", "volatility across scales", lambda a, b: kernels.correlation_gap(a.reshape(-1, k, k), b.reshape(-1, k, k)), lambda x: kernels.scale_correlation(x, scales).reshape(-1, k * k)),
        TailRegime(lookback=lookback),
    ]


def _features(corpus: DataFrame, bucket: Bucket) -> DataFrame:
    """(path_id, f array<double>): computed once a path, not once a draw."""
    if bucket.feature is None:
        return corpus.select("path_id", F.col("values").alias("f"))
    feature = bucket.feature

    def run(frames):
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"path_id": pdf["path_id"], "f": list(feature(np.stack(pdf["values"])))})

    return corpus.select("path_id", "values").mapInPandas(run, "path_id long, f array<double>")


def gap_table(real: DataFrame, synthetic: DataFrame | None, bucket: Bucket, draws: list[tuple[int, str, int, int]]) -> DataFrame:
    """(resample, g_rr, g_sr) of the draws' rows: gaps of side a against b, and against s; null where a side is missing."""
    return gap_tables(real, {"": synthetic} if synthetic is not None else {}, bucket, {"": draws}).drop("generator")


def gap_tables(real: DataFrame, generators: dict[str, DataFrame], bucket: Bucket, draws: dict[str, list[tuple[int, str, int, int]]]) -> DataFrame:
    """gap_table of each generator's draws, in one job: (generator, resample, g_rr, g_sr).

    Draws join the paths' features on path_id and meet by generator and resample: tasks are resamples, each holding its own
    draws. The real corpus's features are worked out once for all generators.
    """
    spark = real.sparkSession
    rows = zip(*[(g, *d) for g, ds in draws.items() for d in ds], strict=True)
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    drawn = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["generator", "resample", "side", "pos", "path_id"]))
    parts = drawn.filter("side in ('a', 'b')").join(_features(real, bucket), "path_id")
    for g, corpus in generators.items():
        parts = parts.unionByName(drawn.filter((F.col("side") == "s") & (F.col("generator") == g)).join(_features(corpus, bucket), "path_id"))
    gap = bucket.gap

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {k: np.stack(x.sort_values("pos")["f"]) for k, x in pdf.groupby("side")}
        one = lambda x: float(gap(side["a"], side[x])) if x in side else None
        return pd.DataFrame({"generator": [pdf["generator"].iloc[0]], "resample": [pdf["resample"].iloc[0]], "g_rr": [one("b")], "g_sr": [one("s")]})

    return parts.groupBy("generator", "resample").applyInPandas(score, "generator string, resample long, g_rr double, g_sr double")


def _gaps(table: DataFrame, column: str) -> np.ndarray:
    return np.array([r[column] for r in table.orderBy("resample").collect()], float)  # a row per resample


def rr_gaps(bucket: Bucket, real: DataFrame, n_per_half: int, n_resamples: int, rng: np.random.Generator, sampler: Sampler | None = None) -> np.ndarray:
    """Gaps between disjoint halves of the real corpus, one a resample."""
    draws = unpaired_draws(sampler or PooledSampler(real.count()), None, n_per_half, n_resamples, rng)
    return _gaps(gap_table(real, None, bucket, draws), "g_rr")


def sr_gaps(bucket: Bucket, real: DataFrame, synthetic: DataFrame, n: int, n_resamples: int, rng: np.random.Generator, real_sampler: Sampler | None = None) -> np.ndarray:
    """Gaps between draws of the real and of the synthetic corpus, one a resample; with replacement from one of no more than n paths."""
    draws = unpaired_draws(real_sampler or PooledSampler(real.count()), synthetic.count(), n, n_resamples, rng)
    return _gaps(gap_table(real, synthetic, bucket, draws), "g_sr")


def rr_sr_gaps_paired(bucket: Bucket, real: DataFrame, synthetic: DataFrame, n: int, n_resamples: int, rng: np.random.Generator, sampler: Sampler | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both kinds of gaps with one first half of the real corpus for both."""
    draws = paired_draws(sampler or PooledSampler(real.count()), synthetic.count(), n, n_resamples, rng)
    rows = gap_table(real, synthetic, bucket, draws).orderBy("resample").collect()  # a row per resample
    return np.array([r.g_rr for r in rows], float), np.array([r.g_sr for r in rows], float)


def verify_fast(real: DataFrame, synthetic: DataFrame, k2=(60, 390), k3=(1, 390), paths: int = 20, tolerance: float = 1e-10) -> None:
    """An error unless the FFT curves give the gaps of the summed ones, on each side's first paths."""
    long = gaps.two(*(to_long(c.filter(F.col("path_id") < paths), "path_id") for c in (real, synthetic)))
    for (lo, hi), leverage in ((k2, False), (k3, True)):
        lags = range(lo, hi + 1)
        a, b = (gaps.curve_gap(f(long, lags, leverage)).first()["gap"] for f in (gaps.lag_curves, gaps.fast_curves))
        if abs(a - b) >= tolerance:
            raise ValueError(f"fast and summed curves differ by {abs(a - b):.3g}")


def similarity(g_rr: np.ndarray, g_sr: np.ndarray) -> float:
    """mean(g_rr) / (mean(g_rr) + mean(g_sr)); 0 where the sum is not above 0, NaN included. 0.5 is the noise floor."""
    a, b = float(np.mean(g_rr)), float(np.mean(g_sr))
    return a / (a + b) if a + b > 0 else 0.0


def similarity_with_ci(g_rr: np.ndarray, g_sr: np.ndarray, n: int, rng: np.random.Generator, paired: bool = True) -> tuple[float, float, float]:
    """Point estimate and 95 % bootstrap interval; paired resampling takes one index vector for both arms."""
    if paired and len(g_rr) != len(g_sr):
        raise ValueError(f"paired arms must be as long as each other: {len(g_rr)} and {len(g_sr)}")
    size, boot = len(g_rr), np.empty(n)
    for i in range(n):
        at = rng.integers(0, size, size)
        boot[i] = similarity(g_rr[at], g_sr[at if paired else rng.integers(0, size, size)])
    lo, hi = np.percentile(boot, [2.5, 97.5])
    return similarity(g_rr, g_sr), float(lo), float(hi)


def similarity_with_ci_unpaired(g_rr: np.ndarray, g_sr: np.ndarray, n: int, rng: np.random.Generator) -> tuple[float, float, float]:
    return similarity_with_ci(g_rr, g_sr, n, rng, paired=False)


def cell_seeds(n: int, seed: int = SEED) -> list[int]:
    return [int(s.generate_state(1, dtype=np.uint32)[0]) for s in np.random.SeedSequence(seed).spawn(n)]


_SCORES = "bucket string, generator string, sim double, ci_lo double, ci_hi double, g_rr_mean double, g_sr_mean double, cv_rr double"


def run_benchmark(real: DataFrame, generators: dict[str, DataFrame], which: list[Bucket] | None = None, n: int = PATHS, resamples: int = RESAMPLES, bootstrap: int = BOOTSTRAP, seed: int = SEED, sampler: Sampler | None = None) -> DataFrame:
    """A row of scores per bucket and generator. Seeds are dealt bucket by bucket over the generators present."""
    if not generators:
        raise ValueError("no synthetic corpus")
    which = which or buckets()
    sizes = {g: c.count() for g, c in generators.items()}
    sampler = sampler or PooledSampler(real.count())
    seeds, out = iter(cell_seeds(len(which) * len(generators), seed)), []
    for bucket in which:
        fitted, dealt = bucket.fit(real), {g: next(seeds) for g in generators}
        draws = {g: paired_draws(sampler, sizes[g], n, resamples, np.random.default_rng(s)) for g, s in dealt.items()}
        got = gap_tables(real, generators, fitted, draws).toPandas().sort_values("resample")  # a row per generator and resample
        for g, s in dealt.items():
            mine = got[got["generator"] == g]
            rr, sr = mine["g_rr"].to_numpy(float), mine["g_sr"].to_numpy(float)
            sim, lo, hi = similarity_with_ci(rr, sr, bootstrap, np.random.default_rng(s + 2))
            cv = float(rr.std() / rr.mean()) if rr.mean() else float("nan")
            out.append((bucket.name, g, sim, lo, hi, float(rr.mean()), float(sr.mean()), cv))
    return real.sparkSession.createDataFrame(out, _SCORES)


def composite(scores: DataFrame) -> DataFrame:
    """Per generator: geometric and arithmetic mean of scores held to at least 1e-6, the plain mean, and the rank by it."""
    held = F.greatest("sim", F.lit(1e-6))
    per = scores.groupBy("generator").agg(F.exp(F.avg(F.ln(held))).alias("geometric"), F.avg(held).alias("arithmetic"), F.avg("sim").alias("composite"))
    from pyspark.sql import Window as W

    return per.withColumn("place", F.row_number().over(W.orderBy(F.col("composite").desc(), "generator")).cast("long"))  # a row per generator


def report(scores: DataFrame) -> str:
    """The table as text: a line per bucket, composites, ranking. Scores are a row per bucket and generator."""
    rows, comp = scores.collect(), composite(scores).orderBy("place").collect()
    names = sorted({r.generator for r in rows})
    cell = {(r.bucket, r.generator): f"{r.sim:.4f} [{r.ci_lo:.4f},{r.ci_hi:.4f}]" for r in rows}
    lines = [f"{'Bucket':<8} | " + " | ".join(f"{g:<22}" for g in names)]
    lines += [f"{b:<8} | " + " | ".join(f"{cell.get((b, g), ''):<22}" for g in names) for b in sorted({r.bucket for r in rows})]
    by = {r.generator: r for r in comp}
    lines += [f"Composite ({k}) | " + " | ".join(f"{by[g][k]:.4f}" for g in names) for k in ("geometric", "arithmetic")]
    return "\n".join([*lines, *(f"  {r.place}. {r.generator:<8} composite={r.composite:.4f}" for r in comp)])
