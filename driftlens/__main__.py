"""Command line: ``python -m driftlens build|transform|labels|score`` (or through spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.corpus import corpus_line, validate
from .plans import build, protocol
from .schemas import WINDOW
from .sources import tables


def score(spark: SparkSession, out: str, names: list[str]) -> str:
    """The report over the generators whose corpora are there; others are skipped, an error if none is."""
    ref = build.reference(spark, out)
    real, found, lines = tables.read_corpus(spark, tables.real_corpus(out)), {}, []
    for name, path in tables.generator_corpora(names, out).items():
        if not tables.exists(spark, path):
            lines.append(f"  SKIP {name}: missing")
            continue
        found[name] = tables.read_corpus(spark, path)
    if not found:
        raise SystemExit("no synthetic corpus found")
    for name, corpus in {"real": real, **found}.items():
        stats = validate(corpus, name, ref["window_len"], ref["reference_std"])
        lines.append(corpus_line(name, stats) + (f"  WARN std is {stats['relative']:.1%} off" if stats["warning"] else ""))
    protocol.verify_fast(real, next(iter(found.values())))
    return "\n".join([*lines, protocol.report(protocol.run_benchmark(real, found))])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="driftlens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, takes in (("build", ["data"]), ("transform", ["parquet", "name"]), ("labels", ["data"]), ("score", ["names"])):
        c = sub.add_parser(name)
        for a in takes:
            c.add_argument(a, nargs="+" if a == "names" else None)
        c.add_argument("--output", default=tables.output_dir())
        c.add_argument("--window", type=int, default=WINDOW)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("driftlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "build":
        print(build.build_dataset(spark, a.data, a.output, a.window))
    elif a.command == "transform":
        print(build.transform_synthetic(spark, a.parquet, a.output, a.name, a.window).count())
    elif a.command == "labels":
        for r in build.regenerate_labels(spark, a.data, a.output, a.window).collect():  # two regimes
            print(r.asDict())
    else:
        print(score(spark, a.output, a.names))


if __name__ == "__main__":
    main()
