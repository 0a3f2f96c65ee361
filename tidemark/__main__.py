"""The command line: panels from raw tables, data sets from panels, experiments from data sets.

    python -m tidemark tables --raw-dir DIR
    python -m tidemark panel (--raw-dir DIR | --example) --interim-dir DIR [--timed | --snapshot | --both] [--rules FILE] [--one-line]
    python -m tidemark datasets --interim-dir DIR [--missing-threshold X] [--max-missing-per-row N]
    python -m tidemark experiments --interim-dir DIR [--setting NAME ...] [--model NAME ...] [--seed N ...] [--runs N] [--grouped COLUMN ...] [--fit STEP ...]
    python -m tidemark all ... [--skip-experiments]

`tables` writes a small example of the raw tables; with --example a panel is built from it, below the interim folder.
With --runs, that many of the models and seeds of each setting are drawn.  With --grouped, the chosen data sets are
run with imputation, scaling or both fitted apart by each of the columns.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.plans import experiments
from tidemark.plans.evaluation import drawn, grid
from tidemark.plans.panel import build_panel, verify
from tidemark.plans.rules import Rules, load_rules
from tidemark.plans.sources import Sources
from tidemark.sources.example import frames_of, write_tables
from tidemark.sources.tables import write_csv, write_panel, write_runs

SETTINGS = ["controlled", "leakboth", "no_team", "no_rounds", "leak_features", "leak_target"]
TEAM = ["Percent_Females", "WorkExp_Idx_Mean", "Total_Founders", "Total_People", "Highest_Degree_Mean", "Avg_Earliest_Year", "Highest_Degree_CEO", "Gender_CEO_Female", "WorkExperienceIndex_CEO"]
ROUNDS = ["N_Deal", "TotalRaised", "TotalInvestors", "UndisclosedAmountShare", "MeanMedianRoundAmount_cum", "MeanTotalInvestments_cum"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("tables").add_argument("--raw-dir", required=True)
    for name in ("panel", "datasets", "experiments", "all"):
        p = commands.add_parser(name)
        p.add_argument("--interim-dir", required=True)
        if name in ("panel", "all"):
            raw = p.add_mutually_exclusive_group(required=True)
            raw.add_argument("--raw-dir")
            raw.add_argument("--example", action="store_true", help="build from the example of the raw tables")
            p.add_argument("--rules", default=None, help="a YAML or JSON file of the panel's rules")
            p.add_argument("--one-line", action="store_true", help="no field of the raw tables holds a line break, so that large files are split")
            which = p.add_mutually_exclusive_group()
            for flag in ("timed", "snapshot", "both"):
                which.add_argument(f"--{flag}", action="store_const", const=flag, dest="which")
            p.set_defaults(which="both")
        if name in ("datasets", "all"):
            p.add_argument("--missing-threshold", type=float, default=0.5)
            p.add_argument("--max-missing-per-row", type=int, default=6)
        if name in ("experiments", "all"):
            p.add_argument("--setting", nargs="+", choices=[*SETTINGS, "all"], default=["all"])
            p.add_argument("--model", nargs="+", default=["lr", "rf"])
            p.add_argument("--seed", nargs="+", type=int, default=[1, 2, 3, 4, 5])
            p.add_argument("--runs", type=int, default=None, help="how many of the models and seeds to draw for each setting; all without it")
            p.add_argument("--grouped", nargs="+", default=[], metavar="COLUMN", help="columns by which imputation and scaling are fitted apart")
            p.add_argument("--fit", nargs="+", choices=["impute", "scale", "both"], default=["impute", "scale", "both"], help="what is fitted apart")
        if name == "all":
            p.add_argument("--skip-experiments", action="store_true", help="stop after the data sets")
    return top


def tables(spark: SparkSession, args: argparse.Namespace) -> None:
    write_tables(frames_of(spark), args.raw_dir)


def panels(spark: SparkSession, args: argparse.Namespace) -> None:
    folder = f"{args.interim_dir}/example" if args.example else args.raw_dir
    if args.example:
        write_tables(frames_of(spark), folder)
    rules = load_rules(spark, args.rules) if args.rules else Rules()
    for timed in (True, False):
        name = "timed" if timed else "snapshot"
        if args.which in (name, "both"):
            out = build_panel(Sources(spark, folder, multi_line=not args.one_line), timed, rules)
            write_panel(out["panel"], f"{args.interim_dir}/panel_{name}")
            verify(spark.read.parquet(f"{args.interim_dir}/panel_{name}"), rules)
            write_csv(out["lost"], f"{args.interim_dir}/lost_{name}")


def datasets(spark: SparkSession, args: argparse.Namespace) -> None:
    timed, snapshot = (spark.read.parquet(f"{args.interim_dir}/panel_{n}") for n in ("timed", "snapshot"))
    made = experiments.processed_datasets(timed, snapshot, least_share=args.missing_threshold, most_in_row=args.max_missing_per_row)
    for name, df in made.items():
        write_panel(df, f"{args.interim_dir}/{name}")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    controlled, leak = (spark.read.parquet(f"{args.interim_dir}/{n}") for n in ("controlled", "leakboth"))
    chosen = SETTINGS if "all" in args.setting else args.setting
    made = experiments.settings(controlled, leak, TEAM, ROUNDS)
    variants = {name: {"setting": name, "impute_by": None, "group": None, "families": args.model} for name in chosen}
    if args.grouped:
        variants = experiments.grouped_variants(chosen, {c: c for c in args.grouped}, args.fit)
    for tag, variant in variants.items():
        df = made[variant["setting"]]
        texts = [c for c, kind in df.dtypes if kind == "string" and c != experiments.KEY]
        numbers = [c for c in df.columns if c not in (experiments.KEY, experiments.TARGET, *texts)]
        models = [m for m in args.model if m in variant["families"]]
        metrics, runs = [], drawn(grid({"seed": args.seed, "model": models}), args.runs)
        for seed in dict.fromkeys(r["seed"] for r in runs):
            families = {r["model"]: {} for r in runs if r["seed"] == seed}
            rows, scored = experiments.run_grid(df, texts, numbers, families, [seed], variant["group"], strata=controlled, impute_by=variant["impute_by"])
            write_runs(scored.withColumn("tag", F.lit(tag)), f"{args.interim_dir}/predictions")
            metrics += rows
        if metrics:
            for row in experiments.summary(spark, metrics).collect():
                print(json.dumps({"setting": tag} | row.asDict()))


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(given)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if args.command == "tables":
        tables(spark, args)
    for command, step in (("panel", panels), ("datasets", datasets), ("experiments", run)):
        if args.command in (command, "all") and not (command == "experiments" and args.command == "all" and args.skip_experiments):
            step(spark, args)


if __name__ == "__main__":
    main()
