"""Bibliographic archives to a dataset folder, and its command line (``python -m vireo.plans.dataset``)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.operators.convert import PROFILES, ConvertConfig, convert, enough_ids
from vireo.runtime import session
from vireo.sources import archives, sinks
from vireo.sources.builders import BUILDERS
from vireo.sources.tables import FILES, UPDATES


def validate(spark: SparkSession, folder: str) -> str:
    """``folder`` if it holds all required tables, else an error."""
    missing = [n for n in FILES if not sinks.exists(spark, f"{folder}/{n}")]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return folder


def wide(rows: DataFrame, vec: str, dim: int) -> DataFrame:
    """The other columns, and one column f1, f2, ... for each element of ``vec``."""
    return rows.select(*[c for c in rows.columns if c != vec], *[F.col(vec)[j].alias(f"f{j + 1}") for j in range(dim)])


def convert_archives(spark: SparkSession, input_glob: str, output_dir: str, config: ConvertConfig, overwrite: bool = False, strict: bool = False, dry_run: bool = False, attr_updates: bool = False) -> dict:
    """Writes edges, features and labels as CSV tables and returns the counters; a dry run only counts.

    A table is a folder of part files, as the tasks write them. Tables that exist are an
    error before anything is read, unless ``overwrite``. An update table of an earlier run is
    removed, or emptied if ``attr_updates``.
    """
    config = config.resolved()
    if not dry_run:
        sinks.guard_outputs(spark, output_dir, FILES, overwrite)
    out = convert(archives.read_until(spark, input_glob, enough_ids(config), config.max_record_bytes, strict), config)
    if dry_run:
        return {k: v for k, v in out.counters.items() if k != "unresolved_references"}
    parts = {"features": wide(out.features, "features", config.feature_dim), "labels": out.labels, "edges": out.edges}
    for name, rows in parts.items():
        sinks.write_table(rows, f"{output_dir}/{name}.csv", overwrite, "csv")
    counters = out.counters | {f"written_{name}": spark.read.option("header", True).csv(f"{output_dir}/{name}.csv").count() for name in parts}
    updates = f"{output_dir}/{UPDATES}"
    sinks.remove_stale(spark, updates)
    if attr_updates:
        none = wide(out.features.where("false").select(F.lit(0).alias("time"), "node_id", "features"), "features", config.feature_dim)
        sinks.write_table(none, updates, True, "csv")
        counters["written_attr_updates"] = 0
    validate(spark, output_dir)
    return counters


def build_dataset(spark: SparkSession, kind: str, inputs: dict[str, str], output_dir: str, overwrite: bool = False, **options) -> dict:
    """Tables of a builder (``sources.builders``) as CSV; returns how many rows each has. Existing tables are an error unless ``overwrite``."""
    build, needed = BUILDERS[kind]
    missing = [n for n in needed if n not in inputs]
    if missing or set(inputs) - set(needed):
        raise ValueError(f"{kind} takes the inputs {', '.join(needed)}")
    sinks.guard_outputs(spark, output_dir, FILES, overwrite)
    sinks.remove_stale(spark, f"{output_dir}/{UPDATES}")
    tables, counts = build(spark, **inputs, **options), {}
    for name, rows in tables.items():
        path = f"{output_dir}/{UPDATES if name == 'updates' else name + '.csv'}"
        if "vec" in rows.columns:
            dim = tables["features"].agg(F.max(F.size("vec"))).first()[0] or 1
            rows = wide(rows, "vec", dim)
        sinks.write_table(rows, path, True, "csv")
        counts[f"written_{name}"] = spark.read.option("header", True).csv(path).count()
    validate(spark, output_dir)
    return counts


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vireo-dataset")
    for flag in ("convert", "validate-only", "dry-run", "overwrite", "fail-on-malformed", "keep-unlabeled", "include-attr-updates"):
        out.add_argument(f"--{flag}", action="store_true")
    out.add_argument("--subset-profile", choices=list(PROFILES), default="custom")
    out.add_argument("--selection-strategy", choices=["dense", "legacy"], default="dense")
    for flag in ("candidate-multiplier", "feature-dim", "min-venue-support", "max-papers", "max-record-bytes"):  # else the profile's
        out.add_argument(f"--{flag}", type=int)
    for flag in ("min-year", "max-year"):
        out.add_argument(f"--{flag}", type=int, default=0)
    out.add_argument("--build", choices=list(BUILDERS), help="make a dataset of this kind from --input files")
    out.add_argument("--input", action="append", default=[], metavar="NAME=PATH")
    for flag in ("max-nodes", "max-edges"):
        out.add_argument(f"--{flag}", type=int)
    out.add_argument("--input-glob", default="dataset/*.zip")
    out.add_argument("--output-dir", default="data")
    return out


def main(argv: list[str] | None = None) -> dict:
    """Without ``--convert`` the folder is only validated."""
    args = parser().parse_args(argv)
    spark = session()
    if args.build:
        options = {k: v for k, v in (("max_nodes", args.max_nodes), ("max_edges", args.max_edges)) if v is not None}
        counts = build_dataset(spark, args.build, dict(x.split("=", 1) for x in args.input), args.output_dir, args.overwrite, **options)
        for name, value in sorted(counts.items()):
            print(f"{name}: {value}")
        return counts
    if args.validate_only or not args.convert:
        print(f"complete: {validate(spark, args.output_dir)}")
        if not args.convert:
            return {}
    config = ConvertConfig(
        args.subset_profile, args.max_papers, args.feature_dim, args.min_venue_support, args.max_record_bytes, args.candidate_multiplier,
        args.selection_strategy, args.keep_unlabeled, args.min_year, args.max_year,
    )
    counters = convert_archives(spark, args.input_glob, args.output_dir, config, args.overwrite, args.fail_on_malformed, args.dry_run, args.include_attr_updates)
    for name, value in sorted(counters.items()):
        print(f"{name}: {value}")
    return counters


if __name__ == "__main__":
    main()
