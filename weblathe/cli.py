"""Command line over the library: analyze, sample, report. Collection itself is not part of this engine."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from weblathe.operators import analysis, sampling
from weblathe.sources import lists, sinks, snapshots


def analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    found = snapshots.read_snapshots(spark, args.snapshots)
    seen = analysis.observations_of_snapshots(found)
    changes = analysis.longitudinal_changes(seen)
    for name, table in (("runs", analysis.runs_of_snapshots(found)), ("observations", seen), ("changes", changes), ("summary", analysis.summary(seen))):
        sinks.write_csv(table, f"{args.out}/{name}")
    print(sinks.summary_json(analysis.totals(seen, changes)), end="")


def frame_sample(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = lists.read_frame(spark, args.frame)
    bad = rows.where("problem is not null").limit(5).collect()
    if bad:
        raise SystemExit("\n".join(f"{r['domain']}: {r['problem']}" for r in bad))
    merged = sampling.merge_frame(rows)
    if merged.where("conflict").limit(1).count():
        raise SystemExit("a domain has different attributes in different rows")
    selection = sampling.select_sample(merged, args.seed, args.per_stratum)
    sinks.write_manifest(selection, sampling.manifest(selection, args.seed, args.per_stratum), args.out)


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    seen = analysis.observations_of_snapshots(snapshots.read_snapshots(spark, args.snapshots))
    print(sinks.markdown_table(analysis.status_counts(seen, "domain").orderBy("domain")))
    print(sinks.markdown_table(analysis.common_statuses(seen).where("rank <= 20").orderBy("outcome", "rank")))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weblathe")
    commands = parser.add_subparsers(required=True)
    for name, run, options in (
        ("analyze", analyze, ("--snapshots", "--out")),
        ("frame-sample", frame_sample, ("--frame", "--out", "--seed")),
        ("report", report, ("--snapshots",)),
    ):
        command = commands.add_parser(name)
        command.set_defaults(run=run)
        for option in options:
            command.add_argument(option, required=True)
        if name == "frame-sample":
            command.add_argument("--per-stratum", type=int, default=4)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("weblathe").getOrCreate(), args)


if __name__ == "__main__":
    main()
