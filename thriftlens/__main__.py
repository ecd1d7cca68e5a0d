"""python -m thriftlens analyze [PATH | SESSION_ID] [--database F] [--dumps D] [--detectors a,b] [--all]: print reports and advice."""

from __future__ import annotations

import argparse
import sys

from thriftlens import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="thriftlens", description="Find wasted tokens in agent sessions.")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command")
    a = commands.add_parser("analyze", help="report on one session: a file's, a folder's newest, or the one of an id; the last one without any")
    a.add_argument("path", nargs="?", help="a .json dump, a .db file, a folder, or a session id")
    a.add_argument("--database", help="where session ids are looked up, and the last session without a path")
    a.add_argument("--dumps", help="a folder of dumps, for its newest one without a path")
    a.add_argument("--detectors", help="names, with commas")
    a.add_argument("--all", action="store_true", help="every session of a database or folder")
    args = parser.parse_args(argv)
    if args.command != "analyze":
        parser.print_help()
        return 0
    from pyspark.sql import SparkSession

    from thriftlens import api

    spark = SparkSession.builder.appName("thriftlens").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    names = args.detectors.split(",") if args.detectors else None
    everything = args.path or args.database or args.dumps
    found = (api.read_all(spark, everything) if everything else None) if args.all else api.read_session(spark, args.path, args.database, args.dumps)
    if found is None:
        print("no session found", file=sys.stderr)
        return 1
    for row in api.analyze(api.Tables(*found), names).orderBy("session_id").toLocalIterator():
        print(row["report"], *[f"\n> {p}" for p in row["prompts"] or []], sep="\n", end="\n\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
