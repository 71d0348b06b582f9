"""Gaps, samplers and the protocol against plain NumPy, and the properties that gaps should have."""

import numpy as np
import pytest
from driftlens.functions import kernels
from driftlens.operators import gaps
from driftlens.operators.corpus import to_long
from driftlens.plans import protocol, samplers

N, T = 40, 120


def paths(seed, n=N, t=T):
    r = np.random.default_rng(seed)
    vol = np.exp(np.cumsum(r.normal(size=(n, t)) * 0.15, axis=1))
    return r.standard_t(4, size=(n, t)) * vol


def frame(spark, x):
    return spark.createDataFrame([(i, f"t{i % 4}", i % 2, v.tolist()) for i, v in enumerate(x)], "path_id long, ticker string, regime byte, values array<double>")


@pytest.fixture(scope="module")
def pair(spark):
    a, b = paths(1), paths(2)
    return a, b, gaps.two(to_long(frame(spark, a), "path_id"), to_long(frame(spark, b), "path_id")).cache()


def one(df):
    return df.first().gap


def slow_curve(x, lags, leverage):
    out = []
    for p in x:
        m = np.abs(p) - np.abs(p).mean()
        e = p - p.mean() if leverage else m
        out.append([(e[: len(p) - k] * m[k:]).sum() / (len(p) * e.std() * m.std()) for k in lags])
    return np.array(out)


def test_b1(pair):
    a, b, long = pair
    u = (np.arange(1000) + 0.5) / 1000
    u = u[(u < 0.05) | (u > 0.95)]
    assert len(gaps.tail_points()) == 100
    want = np.abs(np.quantile(a, u) - np.quantile(b, u)).mean()
    assert one(gaps.b1_gap(long)) == pytest.approx(want) == kernels.tail_gap(a, b)
    with pytest.raises(ValueError):
        gaps.tail_points(0.6)


@pytest.mark.parametrize("leverage", [False, True])
def test_b2_b3_in_every_form(pair, leverage):
    a, b, long = pair
    lags = range(1, 21)
    slow = [slow_curve(x, lags, leverage) for x in (a, b)]
    want = np.abs(slow[0].mean(axis=0) - slow[1].mean(axis=0)).mean()
    assert np.allclose(kernels.lag_curve(a, 1, 20, leverage), slow[0], atol=1e-10)
    assert one((gaps.b3_gap if leverage else gaps.b2_gap)(long, lags)) == pytest.approx(want, abs=1e-10)
    assert one(gaps.curve_gap(gaps.fast_curves(long, lags, leverage))) == pytest.approx(want, abs=1e-10)


def test_flat_and_short_paths(spark):
    x = np.array([[1.0] * 6, [1.0, -2.0, 3.0, 0.5, -1.0, 2.0]])
    got = kernels.lag_curve(x, 1, 8)
    assert np.all(got[0, :5] == 0) and np.isnan(got[:, 5:]).all()
    long = to_long(frame(spark, x), "path_id").selectExpr("'a' as side", "*")
    rows = {(r.path_id, r.lag): r.c for r in gaps.lag_curves(long, range(1, 9)).collect()}
    assert rows[0, 1] == 0 and rows[1, 6] is None and rows[1, 2] == pytest.approx(got[1, 1])


def test_b4(pair):
    a, b, long = pair
    assert one(gaps.b4_gap(long, T, (1, 5, 7, 50))) == pytest.approx(kernels.kurtosis_gap(a, b, (1, 5, 7, 50)), abs=1e-10)
    assert kernels.l_kurtosis(np.random.default_rng(0).normal(size=200_000)) == pytest.approx(0.1226, abs=2e-3)
    assert np.isnan(kernels.l_kurtosis(np.ones(9))) and np.isnan(kernels.l_kurtosis(np.ones(3)))
    assert one(gaps.b4_gap(long, T, (1000,))) is None
    with pytest.raises(ValueError):
        gaps.b4_gap(long, T, (1, 5), (1.0,))


def tied(spark):
    """Paths of which three returns in ten are zero and many others repeat, as minute bars have them."""
    r = np.random.default_rng(9)
    a, b = (np.where(r.random((N, T)) < 0.3, 0.0, np.round(r.standard_t(3, (N, T)), d)) for d in (1, 2))
    return a, b, gaps.two(to_long(frame(spark, a), "path_id"), to_long(frame(spark, b), "path_id"))


@pytest.mark.parametrize("bins", [4096, 2])
def test_ties_count_each(spark, monkeypatch, bins):
    monkeypatch.setattr(gaps.order, "BINS", bins)
    monkeypatch.setattr(gaps.order, "BIN_ROWS", 50)
    a, b, long = tied(spark)
    assert one(gaps.b1_gap(long)) == pytest.approx(kernels.tail_gap(a, b), abs=1e-12)
    assert one(gaps.b4_gap(long, T, (1, 5, 7))) == pytest.approx(kernels.kurtosis_gap(a, b, (1, 5, 7)), abs=1e-10)
    bounds = [float(np.quantile(kernels.rolling_vol(a, 20)[1], k / 3)) for k in (1, 2)]
    want = kernels.tail_regime_gap(kernels.rolling_vol(a, 20), kernels.rolling_vol(b, 20), bounds)
    assert one(gaps.b6_gap(long, lookback=20)) == pytest.approx(want, abs=1e-6)
    rows = spark.createDataFrame([("x", v) for v in [0.0] * 900 + [1.0, 1.0, -2.0, None]], "g string, v double")
    got = {r.v: (r["_c"], r["rank"], r.n) for r in gaps.order.ranked(rows, "v", ["g"]).collect()}
    assert got == {-2.0: (1, 0, 903), 0.0: (900, 1, 903), 1.0: (2, 901, 903)}


def test_fast_curves_take_paths_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(gaps, "FFT_VALUES", 100)
    r = np.random.default_rng(4)
    rows = [("ab"[i % 2], i, r.normal(size=n).tolist()) for i, n in enumerate([30, 31, 30, 5, 60, 60, 30, 1, 0, 30, 30])]
    paths_ = spark.createDataFrame(rows, "side string, path_id long, values array<double>").repartition(2)
    lags = range(2, 12)
    want, total = {}, {}
    for side, i, v in rows:
        for k, c in zip(lags, kernels.lag_curve(np.array([v]), 2, 11)[0] if v else []):
            want[side, i, k] = None if np.isnan(c) else c
            if not np.isnan(c):
                total.setdefault((side, k), []).append(c)
    got = {(x.side, x.path_id, x.lag): x.c for x in gaps.fast_curves(paths_, lags).collect()}
    assert got.keys() == want.keys() and all(got[k] == (None if c is None else pytest.approx(c, abs=1e-12)) for k, c in want.items())
    means = {(x.side, x.lag): x.c for x in gaps.fast_mean_curves(paths_, lags).collect()}
    assert means == {k: pytest.approx(np.mean(c), abs=1e-12) for k, c in total.items()}


def test_b5(pair):
    a, b, long = pair
    scales, got = (5, 20, 60), []
    for x in (a, b):
        v = np.stack([[np.sqrt(np.convolve(p * p, np.ones(s) / s, "valid"))[-(T - 59) :] for s in scales] for p in x])
        got.append(np.mean([np.corrcoef(p) for p in v], axis=0))
    want = np.linalg.norm(got[0] - got[1])
    assert one(gaps.b5_gap(long, scales)) == pytest.approx(want, abs=1e-9)
    assert kernels.correlation_gap(*(kernels.scale_correlation(x, scales) for x in (a, b))) == pytest.approx(want, abs=1e-9)
    assert one(gaps.b5_gap(long, (5, 500))) is None


def test_b6(pair):
    a, b, long = pair
    ra, va = kernels.rolling_vol(a, 20)
    assert va[0] == pytest.approx(a[0, :20].std(ddof=1)) and ra[0] == a[0, 20]
    bounds = [float(np.quantile(va, k / 3)) for k in (1, 2)]
    want = kernels.tail_regime_gap((ra, va), kernels.rolling_vol(b, 20), bounds)
    assert one(gaps.b6_gap(long, lookback=20)) == pytest.approx(want, abs=1e-6)
    assert kernels.rolling_vol(a, T)[0].size == 0


@pytest.mark.parametrize("xi", [-0.3, 0.0, 0.3, 0.8])
def test_pareto_shapes_are_found(xi):
    u = np.random.default_rng(5).uniform(size=40_000)
    x = -np.log(u) if xi == 0 else (u**-xi - 1) / xi
    assert kernels.gpd_shape(2.5 * x) == pytest.approx(xi, abs=0.03)


def test_tail_indices_use_every_exceedance(spark):
    r = np.random.default_rng(1)
    groups = {("a", 0): 2.0 * ((1 - r.random(60_000)) ** -0.3 - 1) / 0.3, ("b", 1): r.exponential(size=500), ("a", 2): r.exponential(size=49), ("b", 2): np.zeros(80), ("a", 1): r.random(400)}
    rows = spark.createDataFrame([(s, g, float(x)) for (s, g), v in groups.items() for x in v], "side string, regime int, e double")
    got = {(x.side, x.regime): (x.n, x.xi) for x in gaps.tail_indices(rows).collect()}
    assert got["a", 2] == (49, None) and got["b", 2] == (80, None)
    for k in (("a", 0), ("b", 1), ("a", 1)):
        assert got[k][0] == len(groups[k]) and got[k][1] == pytest.approx(kernels.gpd_shape(groups[k]), abs=1e-6)
    assert got["a", 0][1] == pytest.approx(0.3, abs=0.02)
    assert gaps.tail_indices(rows.limit(0)).count() == 0


def test_properties(spark):
    x = paths(7)
    r = np.random.default_rng(0)
    mixed = r.permuted(x, axis=1)
    assert kernels.tail_gap(x, mixed) == pytest.approx(0) and kernels.l_kurtosis(x.ravel()) == pytest.approx(kernels.l_kurtosis(mixed.ravel()))
    b2 = lambda p, q: kernels.curve_gap(kernels.lag_curve(p, 1, 20), kernels.lag_curve(q, 1, 20))
    assert b2(x, 2 * x) == pytest.approx(0, abs=1e-12) and b2(x, mixed) > 0.02
    assert protocol.Bucket("B1", "", kernels.tail_gap).compute_gap(x, x) == 0
    with pytest.raises(ValueError):
        protocol.Bucket("B1", "", kernels.tail_gap).compute_gap(x, x * np.nan)
    with pytest.raises(ValueError):
        protocol.lag_bucket("B2", "", 5, 5, False)


def test_samplers(spark):
    rng = lambda: np.random.default_rng(3)
    both = rng().choice(30, size=20, replace=False)
    a, b = samplers.PooledSampler(30).draw_pair(10, rng())
    assert (a == both[:10]).all() and (b == both[10:]).all()
    df = frame(spark, paths(0))
    s = samplers.WithinTickerSampler.of(df, 5)
    assert s.eligible_tickers.tolist() == ["t0", "t1", "t2", "t3"]
    a, b = s.draw_pair(5, rng())
    assert len({int(i) % 4 for i in (*a, *b)}) == 1 and len({*a, *b}) == 10
    s = samplers.WithinRegimeSampler.of(df, 1, 10)
    assert s.pool_size == 20 and s.target_regime == 1 and all(i % 2 == 1 for i in s.draw_single(10, rng()))
    for bad in (lambda: samplers.PooledSampler(1), lambda: samplers.PooledSampler(5).draw_pair(3, rng()), lambda: s.draw_pair(11, rng()), lambda: samplers.WithinTickerSampler.of(df, 6), lambda: samplers.WithinRegimeSampler.of(df, 1, 11)):
        with pytest.raises(ValueError):
            bad()
    rows = samplers.paired_draws(samplers.PooledSampler(40), 8, 8, 3, rng())
    assert len(rows) == 72 and len({p for i, side, _, p in rows if side == "s" and i == 0}) < 8  # with replacement
    assert {r[1] for r in samplers.unpaired_draws(samplers.PooledSampler(40), 50, 8, 2, rng())} == {"a", "s"}


def test_benchmark_agrees_with_numpy(spark):
    real, syn = paths(1), paths(2)
    which = protocol.buckets((1, 10), (1, 10), (1, 5, 7), (5, 20), 20)
    out = {r.bucket: r for r in protocol.run_benchmark(frame(spark, real), {"g": frame(spark, syn)}, which, n=15, resamples=6, bootstrap=50).collect()}
    assert list(out) == ["B1", "B2", "B3", "B4", "B5", "B6"]
    va = kernels.rolling_vol(real, 20)[1]
    which[5] = protocol.TailRegime(lookback=20, bounds=[float(np.quantile(va, k / 3)) for k in (1, 2)])
    for bucket, seed in zip(which, protocol.cell_seeds(6), strict=True):
        rng, rr, sr = np.random.default_rng(seed), [], []
        for _ in range(6):
            both = rng.choice(N, size=30, replace=False)
            s = rng.choice(N, size=15, replace=False)
            rr.append(bucket.compute_gap(real[both[:15]], real[both[15:]]))
            sr.append(bucket.compute_gap(real[both[:15]], syn[s]))
        want = protocol.similarity_with_ci(np.array(rr), np.array(sr), 50, np.random.default_rng(seed + 2))
        got = out[bucket.name]
        assert (got.sim, got.ci_lo, got.ci_hi) == pytest.approx(want, abs=1e-8), bucket.name


def test_gaps_of_resamples(spark):
    real, syn = paths(1), paths(2, 25)
    for bucket in protocol.buckets((1, 10), (1, 10), (1, 5, 7), (5, 20), 20)[:3]:
        rng = np.random.default_rng(5)
        want = []
        for _ in range(4):
            both = rng.choice(N, size=30, replace=False)
            want.append(bucket.compute_gap(real[both[:15]], real[both[15:]]))
        assert protocol.rr_gaps(bucket, frame(spark, real), 15, 4, np.random.default_rng(5)) == pytest.approx(want, abs=1e-9)
        for n in (15, 25):
            rng, want = np.random.default_rng(6), []
            for _ in range(4):
                a = rng.choice(N, size=n, replace=False)
                want.append(bucket.compute_gap(real[a], syn[rng.choice(25, size=n, replace=25 <= n)]))
            assert protocol.sr_gaps(bucket, frame(spark, real), frame(spark, syn), n, 4, np.random.default_rng(6)) == pytest.approx(want, abs=1e-9)
        rr, sr = protocol.rr_sr_gaps_paired(bucket, frame(spark, real), frame(spark, syn), 15, 4, np.random.default_rng(7))
        rng = np.random.default_rng(7)
        both = rng.choice(N, size=30, replace=False)
        s = rng.choice(25, size=15, replace=False)
        assert (rr[0], sr[0]) == pytest.approx((bucket.compute_gap(real[both[:15]], real[both[15:]]), bucket.compute_gap(real[both[:15]], syn[s])), abs=1e-9)


def test_unpaired_interval_resamples_each_arm():
    r = np.random.default_rng(1)
    rr, sr = r.random(30), 1 + r.random(30)
    rng, boot = np.random.default_rng(8), []
    for _ in range(40):
        a = rr[rng.integers(0, 30, 30)].mean()
        b = sr[rng.integers(0, 30, 30)].mean()
        boot.append(a / (a + b))
    want = (rr.mean() / (rr.mean() + sr.mean()), *np.percentile(boot, [2.5, 97.5]))
    assert protocol.similarity_with_ci_unpaired(rr, sr, 40, np.random.default_rng(8)) == pytest.approx(want)
    wide, close = (protocol.similarity_with_ci(rr, 2 * rr, 500, np.random.default_rng(9), paired=p) for p in (False, True))
    assert wide[2] - wide[1] > close[2] - close[1]


def test_scores_and_ranks(spark):
    assert protocol.similarity(np.array([1.0]), np.array([3.0])) == 0.25
    assert protocol.similarity(np.array([np.nan]), np.array([1.0])) == 0.0 == protocol.similarity(np.zeros(2), np.zeros(2))
    with pytest.raises(ValueError):
        protocol.similarity_with_ci(np.ones(2), np.ones(3), 5, np.random.default_rng(0))
    assert len(protocol.similarity_with_ci(np.ones(2), np.ones(2), 5, np.random.default_rng(0), paired=False)) == 3
    rows = [(b, g, s, 0.0, 1.0, 1.0, 1.0, 0.1) for g, ss in {"x": (0.5, 0.0), "y": (0.4, 0.4)}.items() for b, s in zip(("B1", "B2"), ss)]
    scores = spark.createDataFrame(rows, protocol._SCORES)
    comp = {r.generator: r for r in protocol.composite(scores).collect()}
    assert comp["x"].geometric == pytest.approx((0.5 * 1e-6) ** 0.5) and comp["x"].composite == 0.25 and (comp["y"].place, comp["x"].place) == (1, 2)
    text = protocol.report(scores)
    assert "B1" in text and "1. y" in text and "Composite (geometric)" in text
    with pytest.raises(ValueError):
        protocol.run_benchmark(scores, {})


def test_fast_curves_are_verified(spark, monkeypatch):
    a, b = frame(spark, paths(1)), frame(spark, paths(2))
    protocol.verify_fast(a, b, (5, 20), (1, 20))
    monkeypatch.setattr(protocol.gaps, "fast_curves", lambda long, lags, leverage: gaps.lag_curves(long, lags, not leverage))
    with pytest.raises(ValueError):
        protocol.verify_fast(a, b, (5, 20), (1, 20))


def test_command_line_scores_what_is_there(spark, tmp_path, capsys, monkeypatch):
    from driftlens.__main__ import main, score
    from driftlens.sources import sinks

    out = f"file://{tmp_path}"
    x = paths(3, 60, 400)
    sinks.write_corpus(frame(spark, x), f"{out}/eval")
    sinks.write_corpus(frame(spark, x[::-1] * 1.5), f"{out}/made")
    sinks.write_manifest(spark, f"{out}/manifest.json", 400, float(x.mean()), float(x.std()))
    few = protocol.run_benchmark
    monkeypatch.setattr(protocol, "run_benchmark", lambda real, found: few(real, found, protocol.buckets((1, 9), (1, 9), (1, 5), (5, 9), 9), n=20, resamples=3, bootstrap=5))
    monkeypatch.setattr(protocol, "verify_fast", lambda *a: None)
    main(["score", "made", "gone", "--output", out], spark)
    said = capsys.readouterr().out
    assert "SKIP gone" in said and "WARN" in said and "1. made" in said
    with pytest.raises(SystemExit):
        score(spark, out, ["gone"])
