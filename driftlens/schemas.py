"""Fixed schemas and default constants of the return-path side."""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("close", T.DoubleType())])
CORPUS = T.StructType([T.StructField("path_id", T.LongType()), T.StructField("ticker", T.StringType()), T.StructField("regime", T.ByteType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
MANIFEST = T.StructType([
    T.StructField("window_len", T.IntegerType()), T.StructField("benchmark_n_paths", T.IntegerType()), T.StructField("benchmark_seed", T.IntegerType()),
    T.StructField("reference_mean", T.DoubleType()), T.StructField("reference_std", T.DoubleType()), T.StructField("units", T.StringType()),
])
SPLIT = T.StructType([T.StructField("train", T.ArrayType(T.StringType())), T.StructField("eval", T.ArrayType(T.StringType()))])

# Fixed values of the benchmark's definition.
ZONE = "America/New_York"
SESSION = (570, 959)
DAY = 390
TIERS = {"train_only": 280, "eval_eligible": 350}
HOLDOUT = 0.20
SEED = 42
HARMONICS = 3
CRASH = "2020-02-19"
WINDOW = 2520
PATHS = 200
RESAMPLES = 200
BOOTSTRAP = 2000
STD_TOLERANCE = 0.20
UNITS = "deseasonalized_log_returns"
