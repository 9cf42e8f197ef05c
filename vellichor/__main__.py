"""``python -m vellichor list`` names the queries, ``python -m vellichor run QUERY FOLDER [--to OUT]`` shows or writes one."""

from __future__ import annotations

import argparse
import sys

from vellichor import catalog
from vellichor.session import build_session


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="vellichor")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query", choices=sorted(catalog.queries()))
    run.add_argument("folder")
    run.add_argument("--to", help="folder for the result as parquet; without it, the first 20 rows are shown")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    result = catalog.queries()[given.query](build_session(), given.folder)
    if given.to:
        result.write.parquet(given.to)
    else:
        result.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
