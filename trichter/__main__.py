"""``python -m trichter`` or ``spark-submit``: ingest raw tables, run the catalogue, ask a question."""

from __future__ import annotations

import argparse
from datetime import date

from trichter.plans.catalogue import ANALYSES, Params, answer, run_catalogue
from trichter.plans.ingest import ingest
from trichter.session import build_session
from trichter.sources.colocated import load_colocated


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="trichter")
    commands = parser.add_subparsers(dest="command", required=True)

    load = commands.add_parser("ingest", help="clean, check and store raw tables")
    load.add_argument("source")
    load.add_argument("target")
    load.add_argument("--format", default="csv", choices=["csv", "parquet", "orc", "json"])
    load.add_argument("--find-date-formats", action="store_true")
    layout = load.add_mutually_exclusive_group()
    layout.add_argument("--by-month", action="store_true")
    layout.add_argument("--buckets", type=int, help="store facts in this many buckets by entity")

    run = commands.add_parser("run", help="write the result of every named analysis")
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--only", nargs="+", choices=sorted(ANALYSES))
    run.add_argument("--format", default="csv", choices=["csv", "parquet"])
    run.add_argument("--side-by-side", type=int, default=4, help="analyses that run at the same time")

    ask = commands.add_parser("ask", help="answer one question from the stored tables")
    ask.add_argument("tables")
    ask.add_argument("question")

    for command in (run, ask):
        command.add_argument("--years", nargs=2, type=int, default=Params.years)
        command.add_argument("--entity", default=Params.entity_id)
        command.add_argument("--period", nargs=2, type=date.fromisoformat, default=Params.period)
        command.add_argument("--compare", nargs=2, type=date.fromisoformat, default=Params.compare)
    return parser.parse_args(arguments)


def main(arguments: list[str] | None = None) -> None:
    args = parse(arguments)
    spark = build_session()
    if args.command == "ingest":
        ingest(
            spark,
            args.source,
            args.target,
            args.format,
            find_date_formats=args.find_date_formats,
            by_month=args.by_month,
            buckets=args.buckets,
        )
        return
    params = Params(tuple(args.years), args.entity, tuple(args.period), tuple(args.compare))
    tables = load_colocated(spark, args.tables)
    if args.command == "run":
        run_catalogue(tables, args.out, params, args.only, args.format, args.side_by_side)
        return
    found = answer(tables, args.question, params)
    print(f"intent: {found.intent}")
    if found.data is not None:
        found.data.show(truncate=False)


if __name__ == "__main__":
    main()
