"""From raw documents to tokens: quality rules, near-copies, repeated passages, source mix, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import common, mixing, pieces, quality, simhash, suffixes

#: Near-copies here: sets of five-word shingles with at least so many hundredths of Jaccard similarity.
SHINGLE, ALIKE = 5, 80


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where the documents have that column."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(dict(like.dtypes)["n_chars"]))
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep, as they are.

    Null and empty texts go, as they have no words; null languages and sources are groups of their own; other columns may have any name.
    """
    common.small_batches(spark)
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-copies, as it is.

    A null doc_id comes last, rows are told apart by doc_id and text, and texts without words are one group.
    """
    common.small_batches(spark)
    return simhash.drop_similar(docs, ALIKE, SHINGLE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a smaller doc_id has too are cut; a text of which nothing is left goes.

    Cuts keep whole characters; null texts stay, and a null doc_id counts as larger than all others.
    """
    common.small_batches(spark)
    return _counted(suffixes.cut_repeats(docs), docs).filter("text is null or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by the sources' target weights.

    Null sources are one source, the last; a text without words counts for nothing and goes.
    """
    common.small_batches(spark)
    return _counted(mixing.mix(docs), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its sampled pieces; their decoding is checked row by row. Null and empty texts have none."""
    common.small_batches(spark, 300)  # whole rows travel here, so fewer at once
    return pieces.encode(docs).select(*docs.columns, "n_pieces", "pieces", "lossless")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("source mixing", source_mix),
    ("SentencePiece", encoded),
]

#: Hashes, suffixes and sampling are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again for the next."""
    docs = common.table(spark, sf_dir, "documents")
    used: list[str] = []
    for name, stage in STAGES:
        docs, path = common.settle(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.delete(spark, *used)
        used = [path]
    return docs
