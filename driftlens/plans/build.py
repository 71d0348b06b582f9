"""The preparation pipelines end to end: from bars to train and eval corpora, from synthetic bars to a corpus, labels anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import liquidity, season, session
from ..schemas import PATHS, SEED, WINDOW
from ..sources import sinks, tables


def clean(bars: DataFrame, mode: str = "drop_then_return") -> DataFrame:
    return session.returns(session.in_session(bars), mode=mode)


def build_dataset(spark: SparkSession, data_dir: str, output_dir: str, window_len: int = WINDOW) -> dict:
    """Bars in CSVs to stats, split, curve, norm stats, both corpora and the manifest. The fit sees training tickers only."""
    returns = clean(tables.read_bar_csvs(spark, data_dir))
    returns.select("ticker", "ts", "date_ny", "minute_of_day", "log_return").write.mode("overwrite").parquet(f"{output_dir}/returns")
    returns = spark.read.parquet(f"{output_dir}/returns")  # read by four passes below
    stats = liquidity.classify(liquidity.liquidity(returns))
    sinks.write_stats(stats, f"{output_dir}/stats")
    split = liquidity.ticker_split(stats)
    sinks.write_split(split, f"{output_dir}/ticker_split.json")
    train, held = (liquidity.side(returns, split, x) for x in ("train", "eval"))
    season.fit_curve(season.tau_profile(train)).write.mode("overwrite").parquet(f"{output_dir}/curve")
    curve = tables.read_curve(spark, f"{output_dir}/curve")
    train, held = season.deseasonalise(train, curve), season.deseasonalise(held, curve)
    norms = season.norm_stats(train)
    sinks.write_norm_stats(norms, f"{output_dir}/norm_stats.json")
    sinks.write_corpus(C.windows(season.normalise(train, norms), "return_normed", window_len, date=None), f"{output_dir}/train")
    sinks.write_corpus(C.windows(held, "return_deseas", window_len), f"{output_dir}/eval")
    s = C.pooled_stats(tables.read_corpus(spark, f"{output_dir}/eval")).first()
    return sinks.write_manifest(spark, f"{output_dir}/manifest.json", window_len, s["mean"], s["std"])


def reference(spark: SparkSession, output_dir: str) -> dict:
    """The manifest, or what it would hold, from the eval corpus."""
    found = tables.read_manifest(spark, f"{output_dir}/manifest.json")
    if found:
        return found
    s = C.pooled_stats(tables.read_corpus(spark, f"{output_dir}/eval")).first()
    return {"window_len": s.most_len, "benchmark_n_paths": PATHS, "benchmark_seed": SEED, "reference_mean": s["mean"], "reference_std": s["std"]}


def transform_synthetic(spark: SparkSession, parquet: str, output_dir: str, name: str, window_len: int = WINDOW, scale: bool = True) -> DataFrame:
    """Synthetic minute bars to an aligned corpus of the benchmark's size, with the real corpus's curve.

    Paths stand in the order in which their tickers first stand in the file, which is what the seed draws from.
    """
    bars = tables.read_wide_parquet(spark, parquet)
    curve = tables.read_curve(spark, f"{output_dir}/curve")
    made = C.windows(season.deseasonalise(clean(bars, "return_then_drop"), curve), "return_deseas", window_len, date=None, places=tables.first_seen(spark, parquet))
    made.write.mode("overwrite").parquet(f"{output_dir}/{name}-windows")
    made = spark.read.parquet(f"{output_dir}/{name}-windows")
    if made.isEmpty():
        raise RuntimeError("no windows; is the path right?")
    ref = reference(spark, output_dir)
    out = C.prepare(made, ref["window_len"], ref["reference_std"], ref["benchmark_n_paths"], ref["benchmark_seed"], scale)
    sinks.write_corpus(out.withColumn("path_id", F.col("pos").cast("long")), f"{output_dir}/{name}", single=True)
    return tables.read_corpus(spark, f"{output_dir}/{name}")


def regenerate_labels(spark: SparkSession, data_dir: str, output_dir: str, window_len: int = WINDOW) -> DataFrame:
    """Labels of the eval corpus from the bars anew; an error unless the values come out the same. Gives regime counts."""
    split = tables.read_split(spark, f"{output_dir}/ticker_split.json")
    returns = liquidity.side(clean(tables.read_bar_csvs(spark, data_dir)), split, "eval")
    new = C.windows(season.deseasonalise(returns, tables.read_curve(spark, f"{output_dir}/curve")), "return_deseas", window_len)
    old = tables.read_corpus(spark, f"{output_dir}/eval").select("path_id", F.col("values").alias("was"))
    close = F.forall(F.zip_with("values", "was", lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)), lambda ok: ok)
    both = new.join(old, "path_id", "full_outer").withColumn("same", F.coalesce(close & (F.size("values") == F.size("was")), F.lit(False)))
    if not both.filter("not same").isEmpty():
        raise ValueError("the eval corpus does not come out the same")
    new.select("path_id", "ticker", "regime").write.mode("overwrite").parquet(f"{output_dir}/eval_labels")
    return C.label_counts(new)
