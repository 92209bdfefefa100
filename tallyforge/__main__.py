"""python -m tallyforge ingest MAILS --table TABLE [--reextract] | fetch --table TABLE [--after DAY] [--before DAY] | poll --table TABLE --checkpoint PATH [--once] [--outcomes PATH]
| list --table TABLE [--size N] [--before ID] [--needs-review] | tidy --table TABLE

fetch and poll read the mailbox of the environment's settings, or --folder; --model asks the environment's language model for what is incomplete."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import bills
from tallyforge.operators.extract import Extractor
from tallyforge.operators.model_pass import model_extractor
from tallyforge.plans.ingest import default_extractor, ingest, reextract
from tallyforge.plans.mailbox import fetch
from tallyforge.session import session
from tallyforge.sources.config import Get, MissingSetting, model_settings
from tallyforge.sources.files import messages
from tallyforge.sources.models import ModelClient
from tallyforge.sources.shared import released
from tallyforge.sources.tables import BillTable
from tallyforge.streaming.poll import poll_mailbox


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tallyforge")
    commands = parser.add_subparsers(dest="command", required=True)
    take, get, poll, show, tidy = (commands.add_parser(name) for name in ("ingest", "fetch", "poll", "list", "tidy"))
    take.add_argument("mails")
    take.add_argument("--reextract", action="store_true")
    get.add_argument("--after")
    get.add_argument("--before")
    poll.add_argument("--checkpoint", required=True)
    poll.add_argument("--once", action="store_true")
    poll.add_argument("--outcomes")
    for p in (get, poll):
        p.add_argument("--folder")
        p.add_argument("--label")
    for p in (take, get, poll):
        p.add_argument("--model", action="store_true")
    show.add_argument("--size", type=int, default=50)
    show.add_argument("--before")
    show.add_argument("--needs-review", action="store_true")
    for p in (take, get, poll, show, tidy):
        p.add_argument("--table", required=True)
    return parser.parse_args(argv)


def extractor_of(args: argparse.Namespace, get: Get) -> Extractor | None:
    """The default one, with a second pass if a model is asked for."""
    if not args.model:
        return None
    settings = model_settings(get)
    if settings is None:
        raise MissingSetting("MODEL_PROVIDER")
    return default_extractor(model_extractor(ModelClient(settings)))


def told(done: DataFrame) -> int:
    """Prints a line for each message; 1 if one failed."""
    failed = 0
    for row in bills.lines(done).toLocalIterator():
        print(row.line)
        failed += row.line.startswith("Failed")
    return int(bool(failed))


def main(argv: list[str]) -> int:
    """0, or 1 if a message failed; usage errors end with 2."""
    args = arguments(argv)
    try:
        extractor = extractor_of(args, os.environ.get) if args.command in ("ingest", "fetch", "poll") else None
        return run(args, extractor)
    except MissingSetting as e:
        print(f"missing or wrong setting: {e}", file=sys.stderr)
        return 2


def run(args: argparse.Namespace, extractor: Extractor | None) -> int:
    spark = session()
    if args.command == "list":
        table = BillTable(spark, args.table, read_only=True)
        page = bills.page(table.read(), args.size, "needs_review" if args.needs_review else None, args.before)
        bills.kept_and_next(page, args.size)[0].orderBy(F.desc("seq")).show(args.size, truncate=False)
        return 0
    table = BillTable(spark, args.table)
    if args.command == "tidy":
        print(f"{table.vacuum()} folders removed")
        return 0
    with released(spark):
        return taken(spark, table, args, extractor)


def taken(spark: SparkSession, table: BillTable, args: argparse.Namespace, extractor: Extractor | None) -> int:
    options = {k: v for k in ("folder", "label") if (v := getattr(args, k, None))}
    if args.command == "fetch":
        return told(fetch(spark, table, args.after, args.before, extractor, **options))
    if args.command == "poll":
        poll_mailbox(spark, table, args.checkpoint, extractor, args.once, outcomes=args.outcomes, **options).awaitTermination()
        return 0
    return told((reextract if args.reextract else ingest)(messages(spark, args.mails), table, extractor))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
