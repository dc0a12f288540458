"""Runners with flags: features, sem, documents, inventory, load. `python -m lexforum <runner> --help` lists the flags.

Each runner is a function of its flags and a session, which gives an exit code; the work is that of the library's jobs.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lexforum.functions import courts
from lexforum.operators import features, jobs, modules, star, structural
from lexforum.sources import readers, sinks


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV with a header or Parquet, by the path's ending; none where nothing is there."""
    try:
        return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _features(spark: SparkSession, a: argparse.Namespace) -> int:
    folders = {k: v for k, v in (("A", a.corpus_a_dir), ("B", a.corpus_b_dir)) if a.corpus in (k, "all")}
    sources = readers.text_files(spark, a.sources).select("path", "text") if a.sources else None
    rows = features.run(spark, folders, a.output_dir, a.max_docs, sources, a.root, most_chars=a.most_chars or None, y1=_table(spark, a.y1) if a.y1 else None)
    print(sinks.descriptives(features.summary(rows).orderBy("corpus", "indicator"), "Indicators"))
    return 0


def _sem(spark: SparkSession, a: argparse.Namespace) -> int:
    given = [t for t in (_table(spark, p) for p in (a.csv_a, a.csv_b)) if t is not None]
    if not given:
        print("no table of features", file=sys.stderr)
        return 1
    df = given[0] if len(given) == 1 else given[0].unionByName(given[1], allowMissingColumns=True)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    model = structural.Model.of(structural.SPECS[a.spec])
    named = df.withColumnsRenamed({long: short for long, short in structural.FEATURES.items() if long in df.columns})
    if a.multigroup:
        print(sinks.descriptives(structural.multigroup(named, "corpus_type", model).orderBy("corpus_type", "left", "op", "right"), a.spec))
        return 0
    print(sinks.descriptives(structural.fit_table(structural.prepared(df, model), model), a.spec))
    if a.bootstrap:
        key = [c for c in ("doc_id", "section_id", "text_length_chars") if c in named.columns]
        print(sinks.descriptives(structural.path_interval(structural.path_replicates(named, model, key, draws=a.bootstrap)), "Main path"))
    return 0


def _documents(spark: SparkSession, a: argparse.Namespace) -> int:
    counted = jobs.run(spark, a.input, a.output, a.corpora, stop_on_error=a.stop_on_error, schemes=courts.SECTIONS_LOOSE if a.loose else courts.SECTIONS)
    print(sinks.descriptives(counted, "Documents"))
    return 0


def _inventory(spark: SparkSession, a: argparse.Namespace) -> int:
    files = readers.inventory(spark, a.root, None if a.skip_hash else int(a.hash_limit_mb * 2**20), a.pruned, not a.by_spark)
    report = sinks.inventory_report(files, a.output)
    if not a.silent:
        print(report)
    return 0


def _load(spark: SparkSession, a: argparse.Namespace) -> int:
    known = modules.loader({}).order()
    if a.list:
        print("\n".join(known))
        return 0
    if not a.only or (a.only != "all" and a.only not in known):
        print(f"--only takes one of: {', '.join([*known, 'all'])}", file=sys.stderr)
        return 4 if a.only else 1
    sources = {name: t for name, place in (x.split("=", 1) for x in a.source) if (t := _table(spark, place)) is not None}
    there = {} if a.reset else star.committed(spark, a.store)
    if not there and not a.reset:
        print(f"{a.store} holds no tables; --reset begins anew", file=sys.stderr)
        return 3
    tables, errors = modules.loader(sources).run(modules.empty(spark) | there, None if a.only == "all" else {a.only})
    for name, error in errors.items():
        print(f"{name}: {error}", file=sys.stderr)
    print(sinks.descriptives(star.commit(tables, a.store, a.dry_run), "Rows"))
    return 5 if errors else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexforum", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="runner", required=True)

    def runner(name: str, f, *flags: tuple[str, dict]) -> None:
        own = sub.add_parser(name)
        own.set_defaults(run=f)
        for flag, options in flags:
            own.add_argument(flag, **options)

    yes = {"action": "store_true"}
    runner("features", _features, ("--corpus", {"choices": ["A", "B", "all"], "default": "B"}), ("--corpus-a-dir", {"default": "data/processed/corpus_a"}), ("--corpus-b-dir", {"default": "data/processed/corpus_b_json"}), ("--output-dir", {"default": "data/features"}), ("--max-docs", {"type": int}),
           ("--sources", {"help": "folder of the documents' texts"}), ("--root", {"default": ""}), ("--y1", {"help": "table of file, place, y1_ebi"}), ("--most-chars", {"type": int, "default": 8000, "help": "characters of a section that are read; 0: all"}))
    runner("sem", _sem, ("--csv-a", {"default": "data/features/indicators_corpus_a"}), ("--csv-b", {"default": "data/features/indicators_corpus_b"}), ("--spec", {"choices": sorted(structural.SPECS), "default": "parcial"}), ("--bootstrap", {"type": int, "default": 0}), ("--multigroup", yes))
    runner("documents", _documents, ("--input", {"required": True}), ("--output", {"required": True}), ("--corpora", {"nargs": "+", "default": ["A", "B"]}), ("--stop-on-error", yes), ("--loose", yes))
    runner("inventory", _inventory, ("--root", {"default": "."}), ("--output", {"required": True}), ("--skip-hash", yes), ("--hash-limit-mb", {"type": float, "default": 100.0}), ("--pruned", {"nargs": "*", "default": []}), ("--by-spark", yes), ("--silent", yes))
    runner("load", _load, ("--store", {"default": "store"}), ("--source", {"nargs": "*", "default": [], "help": "name=path of a source"}), ("--only", {"help": "a module with those it comes after, or all"}), ("--dry-run", yes), ("--reset", {**yes, "help": "begin with empty tables"}), ("--list", yes))
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or SparkSession.builder.appName(f"lexforum {a.runner}").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
