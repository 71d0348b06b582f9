"""Quality rules with thresholds that adapt to language and source (native: DataFrame functions only).

Every metric of a text is a whole number of thousandths, and per (lang, source) a log-linear histogram of those numbers
is the quantile sketch: a value keeps its BITS leading bits, so ranks are exact, a quantile is low by less than one part
in 2 ** (BITS - 1) (and exact below 2 ** BITS), and a sketch has at most 2 ** (BITS - 1) * (65 - BITS) bins, 28,160,
whatever the data. Its merge is addition: it combines on the map side and comes out alike in any order. A group's quantiles are
drawn towards its language's, and those towards the corpus's, with the weight of PRIOR documents, so there is no size at which a
threshold jumps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, materialise, settled, table, words_of

#: metric -> (lower and upper quantile, fence in spreads between them, tolerance in thousandths, "low" too if small values are also odd).
RULES = {
    "mean_word": (0.25, 0.75, 6.0, 0.0, True),
    "symbols": (0.25, 0.75, 6.0, 20.0, False),
    "dup_lines": (0.5, 0.99, 1.0, 20.0, False),
    "repeats": (0.5, 0.99, 1.0, 20.0, False),
}
#: Leading bits that a sketch keeps of a value.
BITS = 10
#: Documents that a wider group counts for beside a narrower one's own.
PRIOR = 200.0
#: A group's spread is at least this share of its language's, and that of the corpus's: many copies don't make it narrow.
LEAST_SPREAD = 0.5
MIN_WORDS = 50
#: Groups of (lang, source) whose thresholds are broadcast: about 100 bytes each.
GROUPS = 100_000


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, first finds included."""
    windows = F.transform(F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda x, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), x))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twins(t: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(t, k)["x"] == e["x"], F.lit(False))
            return F.sort_array(F.transform(F.filter(t, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last"))
        return let(placed, lambda t: F.aggregate(twins(t), start, step)["n"])

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeats"))
    dups = lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups"))
    symbols = F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long")
    # the id keeps filters on the statistics from being pushed below them, which would work them out once more
    once = F.struct(let(words_of(body), words).alias("w"), let(lines, dups).alias("l"), symbols.alias("s"), F.monotonically_increasing_id().alias("once"))
    return (
        docs.withColumn("_w", once)
        .withColumns({"n_words": F.col("_w.w.n"), "word_chars": F.col("_w.w.chars"), "n_symbols": F.col("_w.s"), "n_dup_lines": F.col("_w.l.dups"), "n_lines": F.col("_w.l.n"), "n_repeat_words": F.col("_w.w.repeats")})
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_w")
    )


def _thousandths(part: str, whole: str) -> Column:
    return F.expr(f"(1000 * {part}) div greatest({whole}, 1L)")


METRICS = {
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def sketch_bin(x: Column) -> Column:
    """The least value with the same BITS leading bits."""
    drop = F.greatest(F.length(F.bin(x)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(stats: DataFrame) -> DataFrame:
    """Rows (lang, source, metric, bin, n): the mergeable sketch of every group, over documents that pass the base."""
    bins = F.array(*[F.struct(F.lit(m).alias("metric"), sketch_bin(_thousandths(*METRICS[m])).alias("bin")) for m in RULES])
    return stats.filter("not base_failed").select("lang", "source", F.explode(bins).alias("m")).groupBy("lang", "source", "m.metric", "m.bin").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def _rule(i: int) -> Column:
    """The entry of a row's rule."""
    return F.coalesce(*[F.when(F.col("metric") == m, F.lit(r[i])) for m, r in RULES.items()])


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys..., metric, n, lo, hi): documents, and the two quantiles of the metric's rule."""
    w = W.partitionBy(*keys, "metric")
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))).cast("double")
    return ranked.groupBy(*keys, "metric").agg(F.max("all").alias("n"), at(_rule(0)).alias("lo"), at(_rule(1)).alias("hi"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, metric, low, high): the thresholds in thousandths of every group that has a document past the base."""
    every = quantiles(merge(sketch)).select("metric", F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), F.expr("hi - lo").alias("spread_"))
    drawn = lambda c: F.expr(f"(n * {c} + {PRIOR}D * {c}_) / (n + {PRIOR}D)")
    spread = lambda: F.expr(f"greatest(hi - lo, {LEAST_SPREAD}D * spread_)")

    def narrowed(own: DataFrame, wider: DataFrame) -> DataFrame:
        out = own.join(wider, "metric") if "lang" not in wider.columns else own.join(wider.withColumnRenamed("lang", "lang_"), F.expr("metric = metric_ and lang <=> lang_")).drop("metric_", "lang_")
        return out.withColumns({"lo": drawn("lo"), "hi": drawn("hi")}).withColumn("spread", spread())

    lang = narrowed(quantiles(merge(sketch, "lang"), "lang"), F.broadcast(every))  # a row per metric
    lang = lang.select("lang", F.col("metric").alias("metric_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), F.col("spread").alias("spread_"))
    own = narrowed(quantiles(sketch, "lang", "source"), lang)
    reach = _rule(2) * F.col("spread")
    return own.select("lang", "source", "metric", F.when(_rule(4), F.col("lo") - reach - _rule(3)).otherwise(F.lit(-1.0)).alias("low"), (F.col("hi") + reach + _rule(3)).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): low_/high_ per metric."""
    cols = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}") for m in RULES for c in ("low", "high")]
    return fences(sketch).groupBy("lang", "source").agg(*cols)


def _verdict(stats: DataFrame, limits: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``stats`` and kept, by the limits of each row's (lang, source)."""
    inside = F.lit(True)
    for m in RULES:
        x = _thousandths(*METRICS[m])
        inside &= (x >= F.col(f"t.low_{m}")) & (x <= F.col(f"t.high_{m}"))
    joined = stats.alias("s").join(limits.alias("t"), F.expr("s.lang <=> t.lang and s.source <=> t.source"), "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select(*[f"s.`{c}`" for c in keep], kept.alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per input row: its key columns, statistics, base_failed and kept.

    ``docs`` needs doc_id, text, lang and source; other columns are ignored and repeated rows are judged alike. A null
    or empty text has no words and fails the base; null languages and sources are groups of their own; an empty table
    gives no rows. The statistics are written once to the shared folder (small: no texts), so texts are read once.
    """
    stats, _ = materialise(text_stats(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    limits, _ = materialise(thresholds(sketches(stats)), "thresholds")
    return _verdict(stats, _fit(limits), stats.columns)


def _fit(limits: DataFrame) -> DataFrame:
    return F.broadcast(limits) if limits.count() <= GROUPS else limits


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were, whatever they are called.

    Each row is judged on its own text; a null or empty text fails the base and goes, repeated rows go or stay alike, and
    an empty table gives no rows. Rows are written with their statistics, so the statistics are worked out once, and
    texts are never shuffled: limits are few, and where the groups of (lang, source) pass GROUPS the join is left to Spark.
    """
    plain = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "text", "lang", "source")  # so no column clashes
    stats, _ = materialise(text_stats(plain).drop("text"), "quality")
    limits, _ = materialise(thresholds(sketches(stats)), "thresholds")
    return _verdict(stats, _fit(limits), ["row"]).filter("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lambda: judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return settled(spark, out, "judged")
