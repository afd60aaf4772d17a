"""The command line: run, validate, init."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tabloom import __version__
from tabloom.config import TEMPLATE, load_config, validate_config, with_options
from tabloom.errors import EngineError

DEFAULT = "tabloom.yaml"


def summary(result) -> str:
    rows = [("extracted", result.total_extracted), ("valid", result.total_valid), ("invalid", result.total_invalid), ("duplicates", result.total_duplicates)]
    rows.append(("inserted", "skipped (dry run)" if result.dry_run else result.total_inserted))
    if result.total_skipped_chunks:
        rows.append(("skipped chunks", result.total_skipped_chunks))
    return "\n".join(f"{k:<15}{v}" for k, v in rows)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tabloom", description="Loads spreadsheets into related tables.")
    top.add_argument("--version", action="version", version=f"tabloom {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="extract, validate and load a file or a folder")
    run.add_argument("input_path")
    run.add_argument("-c", "--config", default=DEFAULT)
    run.add_argument("--create-tables", action="store_true", help="create tables that aren't there")
    run.add_argument("--dry-run", action="store_true", help="extract and validate only")
    run.add_argument("--no-review", action="store_true", help="load without review")
    run.add_argument("--chunk-size", type=int)
    run.add_argument("--sheet", help="a sheet's name, or its number from 0")
    run.add_argument("-v", "--verbose", action="store_true")
    run.add_argument("-q", "--quiet", action="store_true")
    check = commands.add_parser("validate", help="check a configuration")
    check.add_argument("-c", "--config", default=DEFAULT)
    init = commands.add_parser("init", help="write a configuration to start from")
    init.add_argument("-c", "--config", "--output", dest="config", default=DEFAULT)
    init.add_argument("--force", action="store_true", help="overwrite without asking")
    return top


def main(argv: list[str] | None = None, *, spark=None, backend=None, ask=input) -> int:
    """Exit code 1 on any error."""
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            path = Path(args.config)
            if path.exists() and not args.force and ask(f"{path} exists. Overwrite? [y/N] ").strip().lower() not in ("y", "yes"):
                print("left as it is")
                return 0
            path.write_text(TEMPLATE, encoding="utf-8")
            print(f"wrote {path}")
        elif args.command == "validate":
            for note in validate_config(args.config):
                print(f"Warning: {note}")
            print("The configuration is valid")
        else:
            from pyspark.sql import SparkSession

            from tabloom.logs import setup_logging
            from tabloom.plans.pipeline import Pipeline

            level = "debug" if args.verbose else "error" if args.quiet else None
            config = with_options(load_config(args.config), log_level=level)
            setup_logging(config.pipeline.log_level, config.pipeline.log_dir)
            spark = spark or SparkSession.builder.appName("tabloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
            sheet = int(args.sheet) if args.sheet and args.sheet.isdigit() else args.sheet
            result = Pipeline(spark, config, backend=backend, ask=ask).run(
                args.input_path, dry_run=args.dry_run, no_review=args.no_review, create_tables=args.create_tables, chunk_size=args.chunk_size, sheet=sheet
            )
            print(summary(result))
    except EngineError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001  the last line of defence
        print(f"Unexpected error: {e}", file=sys.stderr)
        return 1
    return 0
