"""Mixing sources to target weights: hash-random order, range buckets, prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import GAP, materialise, n_words, table

#: Weights by the source's place in code point order, repeating.
CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows that one range of the random order holds on average; ranges grow in number with the input.
RANGE_ROWS = 2_000
#: Ranges whose sums are added up in one task: two to this power; their totals are added up apart.
HIGH_BITS = 10
#: Rows of small tables, ranges or documents on a cut, up to which they are broadcast (about 60 bytes each).
BROADCAST_ROWS = 500_000


def source_targets(sizes: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, weight, target. ``sizes`` has (source, size); it combines to a row per source first.

    Targets are weight * level, but at most max_epochs * source_size; sharing the excess of full sources again and
    again by weight ends at one common level, found directly: sources in the order in which they fill up, the
    level after each. Sizes that are all zero give targets of zero.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # a row per source
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", rest / open_weight)
    # the first source that does not fill up at its level sets the level of all that follow
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _bits(sized: DataFrame) -> int:
    return max(0, min(28, (sized.count() // RANGE_ROWS).bit_length()))


def _salted(docs: DataFrame) -> Column:
    """What a document's place comes from: its doc_id, or, where that is null, its text, so that rows without an id spread."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def _placed(rows: DataFrame, bits: int, seed: str) -> DataFrame:
    """Adds _key, a row's place in the random order, and _range, its leading bits, from __salt."""
    return rows.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("__salt")))).withColumn("_range", F.shiftright(F.conv(F.substring("_key", 1, 7), 16, 10).cast("long"), 28 - bits))


def _before(sums: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds _base: the sum of ``value`` over the ranges of the same ``by`` before each; in two levels, so that no source is one task's."""
    sums = sums.withColumn("_high", F.shiftright("_range", HIGH_BITS))
    high = W.partitionBy(*by).orderBy("_high").rowsBetween(W.unboundedPreceding, -1)
    tops = sums.groupBy(*by, "_high").agg(F.sum(value).alias("_top")).withColumn("_upto", F.coalesce(F.sum("_top").over(high), F.lit(0)))
    tops = tops.select(*[F.col(c).alias(f"_t_{c}") for c in (*by, "_high")], "_upto")
    low = W.partitionBy(*by, "_high").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    out = sums.withColumn("_within", F.coalesce(F.sum(value).over(low), F.lit(0)))
    return out.join(tops, F.expr(" and ".join(f"{c} <=> _t_{c}" for c in (*by, "_high")))).withColumn("_base", F.col("_upto") + F.col("_within")).select(*sums.columns, "_base").drop("_high")


def _ranges(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """(_s, _r, _sum, _size, _target, _epochs, _left): whole epochs, and the words left for the last when range _r begins."""
    sums = _before(keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum")), "_sum", "source")
    out = sums.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source"))
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    out = out.withColumn("_epochs", epochs).withColumn("_left", F.expr("cast(floor(target) as bigint) - _epochs * source_size - _base"))
    return out.select(F.col("r.source").alias("_s"), F.col("_range").alias("_r"), "_sum", F.col("source_size").alias("_size"), F.col("target").alias("_target"), "_epochs", "_left")


def _groups(on_cut: DataFrame) -> DataFrame:
    """(_s, _k, _n, _part, _rows): per source, key and size in a range on a cut, the words that its rows give together.

    ``on_cut`` are rows with the columns of their range. Rows of one key and size are copies and are counted before anything is sorted, so
    copies don't gather; of a source's groups one at most is cut through.
    """
    per = on_cut.groupBy("source", "_range", "_key", "size").agg(F.count("*").alias("_rows"), F.first("_left").alias("_left"))
    within = W.partitionBy("source", "_range").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)
    words = F.col("size") * F.col("_rows")
    left = F.col("_left") - F.coalesce(F.sum(words).over(within), F.lit(0))
    per = per.withColumn("_part", F.greatest(F.lit(0), F.least(words, left)))
    return per.select(F.col("source").alias("_cs"), F.col("_key").alias("_ck"), F.col("size").alias("_cn"), "_part", "_rows")


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Adds _copy, from 0, to rows of one ``by``: numbered in each partition, after those of the partitions before."""
    rows = rows.withColumn("_p", F.spark_partition_id())
    counts = rows.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_first", F.sum("_c").over(W.partitionBy(*by).orderBy("_p")) - F.col("_c"))
    counts = counts.select(*[F.col(c).alias(f"_t_{c}") for c in (*by, "_p")], "_first")
    rows = rows.withColumn("_copy", F.row_number().over(W.partitionBy(*by, "_p").orderBy(F.monotonically_increasing_id())) - 1)
    rows = rows.join(counts, F.expr(" and ".join(f"{c} <=> _t_{c}" for c in (*by, "_p"))))
    return rows.withColumn("_copy", F.col("_copy") + F.col("_first")).drop("_p", "_first", *[f"_t_{c}" for c in (*by, "_p")])


def _own(size: str) -> Column:
    """What one of several copies gives of their _part: the first ones all they have, one what is left, the others nothing."""
    return F.greatest(F.lit(0), F.least(F.col(size), F.col("_part") - F.col("_copy") * F.col(size)))


def plan_mix(sized: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds source_size, target and taken to ``sized`` (of ``measure``, any more): words the mix takes of each row.

    Rows of a source stand in the order of an md5 of seed and doc_id (of the text where the id is null), cut into ranges of
    about RANGE_ROWS rows by the key's leading bits; the ranges' sums are small, and prefix sums over them and within the one
    range on a source's cut place every row, so no source gathers in one task. Whole epochs first, then the rest up to
    the exact budget, floor(target); the document at the cut gives its first words only. Equal keys go by size, and
    rows that agree in both by copy number. Columns of ``sized`` named source_size, target or taken are replaced.
    """
    sized = sized.drop("source_size", "target", "taken")
    plain = sized.select(F.struct(*[f"`{c}`" for c in sized.columns]).alias("row"), "source", "size", "__salt")  # so no column clashes
    keyed = _placed(plain, _bits(sized), seed)
    ranges, _ = materialise(_ranges(keyed.select("source", "_range", "size"), targets), "ranges")
    rows = keyed.join(_fit(ranges), F.expr("source <=> _s and _range = _r")).drop("_s", "_r")
    on_cut = "_left > 0 and _left < _sum"
    groups, _ = materialise(_groups(rows.filter(on_cut).select("source", "_range", "_key", "size", "_left")), "cut")
    rows = rows.join(_fit(groups), F.expr(f"{on_cut} and source <=> _cs and _key = _ck and size = _cn"), "left")
    several = "_part > 0 and _part < size * _rows and _rows > 1"
    part = F.when(F.col("_left") <= 0, F.lit(0)).when(F.col("_left") >= F.col("_sum"), F.col("size")).otherwise(F.expr("_part div _rows"))
    out = lambda df, part: df.select("row.*", F.col("_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"))
    if groups.filter(several.replace("size", "_cn")).isEmpty():
        return out(rows, part).drop("__salt")
    copies = _numbered(rows.filter(several), "source", "_key", "size")
    return out(rows.filter(f"not coalesce({several}, false)"), part).unionByName(out(copies, _own("size"))).drop("__salt")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, __salt) of whole texts, written once to the shared folder; null texts have size 0."""
    return materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _salted(docs).alias("__salt")), "sizes")[0]


def _fit(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is taken.

    The document at a source's cut keeps the words up to the budget, and the white space between them. A null text,
    or one without words, counts for nothing and is left out. An empty table gives no rows.

    Texts don't shuffle: a range lies before its source's cut, beyond it, or on it, which a table of ranges tells, and only
    the documents of the one range on the cut are named. Both are broadcast up to BROADCAST_ROWS rows. Only copies of
    the one document that a cut goes through are numbered, if it has any.
    """
    sizes = measure(docs)
    bits = _bits(sizes)
    keyed = _placed(sizes, bits, seed)
    ranges, _ = materialise(_ranges(keyed, source_targets(sizes, cycle, max_epochs)), "ranges")
    on_cut = keyed.join(ranges.filter("_left > 0 and _left < _sum"), F.expr("source <=> _s and _range = _r"))
    groups, _ = materialise(_groups(on_cut), "cut")
    plain = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "doc_id", "source", "text")  # so no column clashes
    rows = _placed(plain.withColumn("_n", n_words(F.col("text"))).withColumn("__salt", _salted(docs)).filter("_n > 0"), bits, seed)
    rows = rows.join(_fit(ranges), F.expr("source <=> _s and _range = _r"))
    rows = rows.join(_fit(groups), F.expr("source <=> _cs and _key = _ck and _n = _cn"), "left")
    several = "_part > 0 and _part < _n * _rows and _rows > 1"
    part = F.when(F.col("_left") <= 0, F.lit(0)).when(F.col("_left") >= F.col("_sum"), F.col("_n")).otherwise(F.expr("_part div _rows"))
    if groups.filter(several.replace("_n ", "_cn ")).isEmpty():
        return _epochs(rows, part, docs.columns)
    copies = _numbered(rows.filter(several), "source", "_key", "_n")
    return _epochs(rows.filter(f"not coalesce({several}, false)"), part, docs.columns).unionByName(_epochs(copies, _own("_n"), docs.columns))


def _epochs(rows: DataFrame, part: Column, columns: list[str]) -> DataFrame:
    """A copy of the row for each epoch begun; the last may be cut."""
    rows = rows.withColumn("_taken", F.col("_epochs") * F.col("_n") + part).filter("_taken > 0")
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_n")).cast("int"))))
    cut = F.least(F.col("_n"), F.col("_taken") - (F.col("_epoch") - 1) * F.col("_n"))
    head = F.array_join(F.slice(F.split("text", rf"(?<=[^\x20\x09-\x0D])(?={GAP})"), 1, cut.cast("int")), "")
    text = F.when(cut < F.col("_n"), head).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = measure(table(spark, sf_dir, "documents"))
    return plan_mix(sizes, source_targets(sizes)).select("doc_id", "size", "source_size", "target", "taken")
