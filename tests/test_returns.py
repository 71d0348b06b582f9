"""Bars to corpora: hand-made cases, NumPy checks, the preparation end to end."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from driftlens.operators import corpus as C
from driftlens.operators import liquidity, order, season, session
from driftlens.plans import build
from driftlens.sources import sinks, tables
from pyspark.sql import functions as F


def bars(spark, rows, ticker="T"):
    rows = [(ticker, dt.datetime.fromisoformat(t), float(c)) for t, c in rows]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, close double")


TWO_DAYS = [
    ("2020-01-02T14:30:00", 100), ("2020-01-02T14:31:00", 101), ("2020-01-02T14:32:00", 102), ("2020-01-03T14:30:00", 200),
    ("2020-01-03T14:31:00", 202), ("2020-01-03T14:32:00", 204), ("2020-01-03T14:35:00", 300), ("2020-01-03T14:36:00", 303),
]


def test_jumps_stay_when_flagged_bars_go_first(spark):
    got = [r.log_return for r in build.clean(bars(spark, TWO_DAYS)).orderBy("ts").collect()]
    assert got == pytest.approx([np.log(102 / 101), np.log(202 / 102), np.log(204 / 202), np.log(303 / 204)])


def test_jumps_go_when_returns_come_first(spark):
    got = [r.log_return for r in build.clean(bars(spark, TWO_DAYS), "return_then_drop").orderBy("ts").collect()]
    assert got == pytest.approx([np.log(a) for a in (101 / 100, 102 / 101, 202 / 200, 204 / 202, 303 / 300)])


def test_gap_units(spark):
    rows = session.in_session(bars(spark, [("2020-01-02T14:30:00", 1), ("2020-01-02T14:31:30", 1)]))
    assert [r.is_gap for r in session.flags(rows).orderBy("ts").collect()] == [False, True]
    assert [r.is_gap for r in session.flags(rows, floor=True).orderBy("ts").collect()] == [False, False]


def test_session_follows_daylight_saving(spark):
    rows = [("2020-01-02T14:29:59", 1), ("2020-01-02T14:30:00", 1), ("2020-01-02T20:59:59", 1), ("2020-01-02T21:00:00", 1), ("2020-03-09T13:30:00", 1), ("2020-03-09T13:29:00", 1)]
    got = [(r.ts.isoformat(), r.minute_of_day) for r in session.in_session(bars(spark, rows)).orderBy("ts").collect()]
    assert got == [("2020-01-02T14:30:00", 570), ("2020-01-02T20:59:59", 959), ("2020-03-09T13:30:00", 570)]


def test_odd_closes_give_no_return(spark):
    rows = [(f"2020-01-02T14:{30 + i}:00", c) for i, c in enumerate([1, 1, 0, 2, -1, 3, 6])]
    got = [r.log_return for r in session.returns(session.in_session(bars(spark, rows))).orderBy("ts").collect()]
    assert got == pytest.approx([np.log(2)])
    assert session.returns(session.in_session(bars(spark, rows)).limit(0)).count() == 0
    with pytest.raises(ValueError):
        session.returns(session.in_session(bars(spark, rows)), mode="other")


def test_liquidity_tiers_and_split(spark):
    rows = [("a", d, m) for d in range(3) for m in range(d + 1)] + [("b", 0, 0)]
    r = spark.createDataFrame([(t, dt.date(2020, 1, 1 + d)) for t, d, _ in rows], "ticker string, date_ny date")
    stats = {x.ticker: x for x in liquidity.classify(liquidity.liquidity(r), {"low": 1, "high": 2}).collect()}
    assert (stats["a"].median_bars_per_day, stats["a"].trading_days, stats["a"].total_returns) == (2.0, 3, 6)
    assert (stats["a"].liquidity_class, stats["b"].liquidity_class) == ("high", "low")
    names = [f"n{i:03d}" for i in range(23)]
    split = liquidity.split_names(names, ["x"])
    mixed = np.array(names)
    np.random.default_rng(42).shuffle(mixed)
    assert split == {"train": sorted([*mixed[5:].tolist(), "x"]), "eval": sorted(mixed[:5].tolist())}
    assert liquidity.split_names([], ["x"]) == {"train": ["x"], "eval": []}


def test_curve_is_the_least_squares_fit(spark):
    r = np.random.default_rng(0)
    y = 1 + 0.3 * np.cos(2 * np.pi * np.arange(390) / 390) + r.normal(size=390) * 0.01
    profile = spark.createDataFrame([(int(t), float(v)) for t, v in enumerate(y) if t % 3], "tau int, mean_abs_return double")
    tau = np.array([t for t in range(390) if t % 3])
    basis = lambda t: np.stack([np.ones(len(t)), *[f(2 * np.pi * j * t / 390) for j in (1, 2, 3) for f in (np.cos, np.sin)]], axis=1)
    want = basis(np.arange(390)) @ np.linalg.lstsq(basis(tau), y[tau], rcond=None)[0]
    got = [x.s for x in season.fit_curve(profile).orderBy("tau").collect()]
    assert got == pytest.approx(want.tolist(), abs=1e-9)
    with pytest.raises(ValueError):
        season.fit_curve(profile.limit(5))


def test_z_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0)], "ticker string, return_deseas double")
    stats = {r.ticker: (r["mean"], r["std"]) for r in season.norm_stats(df).collect()}
    assert stats == {"a": (2.0, pytest.approx(2**0.5)), "b": (5.0, None), "c": (2.0, 1e-8)}
    got = [r.return_normed for r in season.normalise(df, season.norm_stats(df)).filter("ticker = 'a'").orderBy("return_deseas").collect()]
    assert got == pytest.approx([-(0.5**0.5), 0.5**0.5])


def test_windows_regimes_and_validation_split(spark):
    rows = [(t, i, float(i), dt.date(2020, 2, 18) + dt.timedelta(days=i // 4)) for t, n in (("b", 9), ("a", 27), ("c", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, ts int, r double, date_ny date")
    w = C.windows(df, "r", 4)
    got = [(x.path_id, x.ticker, x.regime, x["values"][0]) for x in w.orderBy("path_id").collect()]
    assert got == [*[(i, "a", int(i > 0), 4.0 * i) for i in range(6)], (6, "b", 0, 0.0), (7, "b", 1, 4.0)]
    val = {x.path_id for x in C.train_val(w, 0.25).filter("is_val").collect()}
    assert val == {4, 5, 7}  # round(1.5) is 2, half to even; at least one
    assert C.windows(df.limit(0), "r", 4).count() == 0
    long = C.to_long(w)
    assert [x["values"] for x in C.to_paths(long, "path_id").orderBy("path_id").collect()] == [x["values"] for x in w.orderBy("path_id").collect()]


def paths(spark, n=30, t=12, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, t)) * 2 + 1
    return x, spark.createDataFrame([(i, f"t{i % 3}", i % 2, v.tolist()) for i, v in enumerate(x)], "path_id long, ticker string, regime byte, values array<double>")


def test_alignment_subsample_and_checks(spark):
    x, df = paths(spark)
    out = np.array([r["values"] for r in C.prepare(df, 12, 0.5, 10).orderBy("pos").collect()])
    want = x[np.random.default_rng(42).choice(30, size=10, replace=False)]
    want = (want - want.mean()) * 0.5 / want.std()
    assert np.allclose(out, want)
    assert C.validate(df, "x", 12, float(x.std()))["warning"] is False and C.validate(df, "x", 12, 99.0)["warning"] is True
    assert "n=  30" in C.corpus_line("x", C.validate(df, "x", 12, 1.0))
    for bad in (lambda: C.validate(df, "x", 13, 1.0), lambda: C.subsample(df, 31), lambda: C.prepare(df, 11, 1.0, 5)):
        with pytest.raises(ValueError):
            bad()
    odd = df.withColumn("values", F.when(F.col("path_id") == 3, F.array_repeat(F.lit(float("nan")), 12)).otherwise(F.col("values")))
    with pytest.raises(ValueError):
        C.validate(odd, "x", 12, 1.0)


@pytest.mark.parametrize("kind", ["normal", "tied", "heavy", "one"])
def test_ranks_and_quantiles_are_exact(spark, kind):
    r = np.random.default_rng(3)
    x = {"normal": r.normal(size=2000), "tied": r.integers(0, 4, 500).astype(float), "heavy": r.standard_cauchy(1500), "one": np.array([7.0])}[kind]
    df = spark.createDataFrame([(int(i % 2) if len(x) > 1 else 0, float(v)) for i, v in enumerate(x)], "g int, v double")
    probs = [0.0, 0.003, 0.25, 0.5, 0.777, 1.0]
    got = {(q.g, q.p): q.q for q in order.quantiles(df, "v", probs, ["g"]).collect()}
    for g in {k for k, _ in got}:
        part = x[g::2] if len(x) > 1 else x
        assert [got[g, p] for p in probs] == pytest.approx(np.quantile(part, probs).tolist(), rel=1e-12)
        rows = order.ranked(df, "v", ["g"]).filter(F.col("g") == g).orderBy("rank").collect()
        values, first, count = np.unique(np.sort(part), return_index=True, return_counts=True)
        assert [(q.v, q["rank"], q["_c"], q.n) for q in rows] == [(v, i, c, len(part)) for v, i, c in zip(values.tolist(), first.tolist(), count.tolist())]


def test_preparation_end_to_end(spark, tmp_path):
    raw, out = tmp_path / "raw", f"file://{tmp_path}/out"
    raw.mkdir()
    r = np.random.default_rng(1)
    for k in range(6):
        lines, price = ["extra,timestamp,close"], 100.0
        for day in (2, 3, 6, 7):
            for m in range(390 if k < 4 else 300):
                price *= np.exp(r.normal() * 0.001 * (1 + 0.5 * np.cos(2 * np.pi * m / 390)))
                t = dt.datetime(2020, 1, day, 14, 30) + dt.timedelta(minutes=m)
                lines.append(f"z,{t:%Y-%m-%dT%H:%M:%SZ},{price}")
        (raw / f"{['AA', 'null', 'CC', 'DD', 'EE', 'F F'][k]}.csv").write_text("\n".join(lines))
    (raw / "download_log.csv").write_text("timestamp,close\n")
    (raw / "none.csv").write_text("a,b\n1,2\n")
    m = build.build_dataset(spark, str(raw), out, window_len=500)
    assert tables.read_manifest(spark, f"{out}/manifest.json") == {**m, "window_len": 500}
    split = {(x.ticker, x.side) for x in tables.read_split(spark, f"{out}/ticker_split.json").collect()}
    assert len(split) == 6 and sum(s == "eval" for _, s in split) == 1
    stats = {x.ticker: x for x in tables.read_stats(spark, f"{out}/stats").collect()}
    assert set(stats) == {"AA", "null", "CC", "DD", "EE", "F F"} and stats["AA"].liquidity_class == "eval_eligible" and stats["EE"].liquidity_class == "train_only"
    held = tables.read_corpus(spark, f"{out}/eval")
    assert held.count() == 3 and m["reference_std"] == pytest.approx(np.array([x["values"] for x in held.collect()]).std())
    assert set(json.loads((tmp_path / "out/norm_stats.json").read_text())) == {t for t, s in split if s == "train"}
    # the eval labels come out again
    assert [(x.regime, x.windows, x.tickers) for x in build.regenerate_labels(spark, str(raw), out, 500).collect()] == [(0, 3, 1)]
    # synthetic bars in the wide layout
    made = tables.read_bar_csvs(spark, str(raw)).filter("ticker in ('AA', 'CC', 'DD')")
    made.select(F.col("ticker").alias("tr_ric"), F.col("ts").alias("timestamp"), "close").write.parquet(f"{out}/wide")
    sinks.write_manifest(spark, f"{out}/manifest.json", 500, m["reference_mean"], m["reference_std"], n=4)
    syn = build.transform_synthetic(spark, f"{out}/wide", out, "syn", 500)
    x = np.array([v["values"] for v in syn.collect()])
    assert x.shape == (4, 500) and x.mean() == pytest.approx(0, abs=1e-6) and x.std() == pytest.approx(m["reference_std"], rel=1e-5)


def test_npy_corpora(spark, tmp_path):
    x = np.arange(12.0).reshape(3, 4, 1)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "t.npy", np.array(["a", "b", "c"]))
    rows = tables.read_npy_corpus(spark, str(tmp_path / "x.npy"), str(tmp_path / "t.npy")).orderBy("path_id").collect()
    assert [r["values"] for r in rows] == x[:, :, 0].tolist() and [r.ticker for r in rows] == ["a", "b", "c"]
    np.save(tmp_path / "y.npy", np.zeros((3, 4, 2)))
    with pytest.raises(ValueError):
        tables.read_npy_corpus(spark, str(tmp_path / "y.npy"))
    with pytest.raises(ValueError):
        np.save(tmp_path / "t.npy", np.array(["a"]))
        tables.read_npy_corpus(spark, str(tmp_path / "x.npy"), str(tmp_path / "t.npy"))


def test_output_folder_setting(monkeypatch):
    monkeypatch.setenv(tables.OUTPUT, "/x/y/")
    assert tables.output_dir() == "/x/y"
    monkeypatch.delenv(tables.OUTPUT)
    assert tables.output_dir() == "output" and os.environ.get(tables.OUTPUT) is None


def test_synthetic_paths_stand_as_their_tickers_first_do(spark, tmp_path):
    import pandas as pd

    out, day = f"file://{tmp_path}/out", dt.datetime(2020, 1, 2, 14, 30)
    r = np.random.default_rng(6)
    rows, prices = [], {}
    for t in ("zz", "mm", "aa", "kk"):  # not sorted
        for m in range(60):
            prices[t] = prices.get(t, 100.0) * np.exp(0.01 * r.normal())
            rows.append((t, day + dt.timedelta(minutes=m), prices[t]))
    pd.DataFrame(rows, columns=["tr_ric", "timestamp", "close"]).to_parquet(tmp_path / "made.parquet", coerce_timestamps="us")
    spark.range(390).select(F.col("id").cast("int").alias("tau"), F.lit(1.0).alias("s")).write.parquet(f"{out}/curve")
    sinks.write_manifest(spark, f"{out}/manifest.json", 20, 0.0, 0.01, n=5)
    got = {x.path_id: (x.ticker, x["values"]) for x in build.transform_synthetic(spark, str(tmp_path / "made.parquet"), out, "made", 20).collect()}
    order_ = [t for t in ("zz", "mm", "aa", "kk") for _ in range(2)]  # 59 returns, two windows each
    drawn = np.random.default_rng(42).choice(8, size=5, replace=False)
    assert [got[i][0] for i in range(5)] == [order_[p] for p in drawn]


def test_folders_of_the_output(monkeypatch):
    monkeypatch.setenv(tables.OUTPUT, "/data/x/")
    assert (tables.real_corpus(), tables.labels(), tables.manifest()) == ("/data/x/eval", "/data/x/eval_labels", "/data/x/manifest.json")
    assert tables.generator_corpora(["a", "b"], "/o") == {"a": "/o/a", "b": "/o/b"}


def test_bar_files_have_headers_of_their_own(spark, tmp_path):
    (tmp_path / "A B.csv").write_text("timestamp,close\n2020-01-02 14:30:00+00:00,1.5\n2020-01-02 14:31:00+00:00,\n")
    (tmp_path / "NA.csv").write_text("close,other,timestamp\n2.5,x,2020-01-02T14:30:00Z\n\n3.5,\"a,b\",2020-01-02T14:31:00Z\n")
    (tmp_path / "nan.csv").write_text("open,close\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "download_log.csv").write_text("timestamp,what\nx,y\n")
    with pytest.warns(UserWarning, match="nan.csv"):
        got = tables.read_bar_csvs(spark, str(tmp_path)).collect()
    assert sorted((r.ticker, r.ts.minute, r.close) for r in got if r.close is not None) == [("A B", 30, 1.5), ("NA", 30, 2.5), ("NA", 31, 3.5)] and len(got) == 4
    (tmp_path / "bad.csv").write_text("timestamp,open\n2020-01-02T14:30:00Z,1\n")
    with pytest.raises(KeyError, match="bad.csv"):
        tables.read_bar_csvs(spark, str(tmp_path))
