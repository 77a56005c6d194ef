"""Commands: python -m sparktab eda | preflight | validate.

eda writes an HTML report in one move and prints its findings as Markdown; preflight prints its report as JSON; validate
prints a run folder's errors, one a line. Input errors are printed as JSON to stderr with exit code 2, and nothing is
written then; validate exits with 1 where there are errors.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .plans import contract, preflight, report
from .session import session
from .sources import readers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparktab")
    commands = out.add_subparsers(dest="command", required=True)
    eda = commands.add_parser("eda", help="an HTML report of a table and its findings")
    eda.add_argument("--input", required=True)
    eda.add_argument("--output", required=True)
    eda.add_argument("--target")
    eda.add_argument("--seed", type=int, default=42)
    eda.add_argument("--max-plot-rows", type=int, default=report.SAMPLE_ROWS)
    eda.add_argument("--max-numeric-charts", type=int, default=report.NUMERIC_CHARTS)
    eda.add_argument("--max-categorical-charts", type=int, default=report.CATEGORY_CHARTS)
    check = commands.add_parser("preflight", help="leakage, duplicate and split findings before modelling")
    check.add_argument("dataset")
    check.add_argument("--target", required=True)
    check.add_argument("--task", choices=("auto", "classification", "regression"), default="auto")
    check.add_argument("--row-grain", required=True)
    check.add_argument("--prediction-moment", required=True)
    check.add_argument("--exclude", action="append", default=[])
    check.add_argument("--max-rows", type=int)
    for one in (eda, check):
        one.add_argument("--time-column")
        one.add_argument("--group-column")
        one.add_argument("--delimiter")
        one.add_argument("--allow-remote", action="store_true", help="read other stores than local files")
    run = commands.add_parser("validate", help="errors of a run folder")
    run.add_argument("folder")
    run.add_argument("--execute", action="store_true", help="run the inference cases as well")
    return out


def available_memory() -> int | None:
    """Bytes of memory that the machine has free, where it says so."""
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_AVPHYS_PAGES")
    except (OSError, ValueError):
        return None


def eda(spark: SparkSession, args: argparse.Namespace) -> str:
    caps = {"max-plot-rows": args.max_plot_rows, "max-numeric-charts": args.max_numeric_charts, "max-categorical-charts": args.max_categorical_charts}
    readers.guard_paths(args.input, args.output, caps, args.allow_remote)
    df = readers.scan(spark, args.input, args.delimiter)
    options = {"target": args.target, "time": args.time_column, "group": args.group_column, "seed": args.seed}
    options |= {"sample_rows": args.max_plot_rows, "numeric_charts": args.max_numeric_charts, "category_charts": args.max_categorical_charts}
    if not args.allow_remote:
        options["fingerprint"] = readers.fingerprint(args.input)
    return "## EDA findings\n\n" + report.write(df, args.output, os.path.basename(args.input), **options)


def inspect(spark: SparkSession, args: argparse.Namespace) -> str:
    readers.guard_paths(args.dataset, None, {} if args.max_rows is None else {"max-rows": args.max_rows}, args.allow_remote)
    df = readers.scan(spark, args.dataset, args.delimiter, args.max_rows, readers.PREFLIGHT_SUFFIXES)
    request = preflight.Request(
        args.target, args.row_grain, args.prediction_moment, None if args.task == "auto" else args.task,
        args.group_column, args.time_column, tuple(args.exclude), available_memory(),
    )
    return json.dumps(preflight.preflight(df, request), indent=2, sort_keys=True, default=str)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "validate":
            if not os.path.isdir(args.folder):
                raise readers.InputError(f"no such folder: {args.folder}")
            errors = contract.validate(args.folder, execute=args.execute)
            print("\n".join(errors) if errors else "no errors")
            return int(bool(errors))
        spark = spark or session("sparktab")
        print((eda if args.command == "eda" else inspect)(spark, args))
    except (OSError, ValueError, PySparkException) as e:
        print(json.dumps({"error": str(e)}, indent=2), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
