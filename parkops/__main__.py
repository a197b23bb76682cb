"""Command line: list the registered queries or run some of them.

    python -m parkops list
    python -m parkops run NAME [NAME ...] --data DIR [--out DIR] [--master local[8]]

``run`` writes each result as Parquet under ``--out/NAME`` when given (written
by the executors), otherwise prints its row count and the first rows.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="parkops")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("names", nargs="+", help="query names, or 'all'")
    run.add_argument("--data", required=True, help="folder holding the input tables")
    run.add_argument("--out", help="folder for the results (Parquet)")
    run.add_argument("--master", default=None, help="Spark master, e.g. local[8]; default: from the cluster")
    args = ap.parse_args(argv)

    from .plans import catalog
    catalog.load_all()
    if args.cmd == "list":
        for name in catalog.QUERIES:
            print(name + ("" if name in catalog.ORACLES else "   (rows-only check)"))
        return 0

    from .session import cleanup_scratch, get_session
    from .sources.io import write_result
    names = list(catalog.QUERIES) if args.names == ["all"] else args.names
    unknown = [n for n in names if n not in catalog.QUERIES]
    if unknown:
        print(f"unknown queries: {', '.join(unknown)}", file=sys.stderr)
        return 2
    spark = get_session(args.master)
    for name in names:
        df = catalog.QUERIES[name](spark, args.data)
        if args.out:
            write_result(df, f"{args.out.rstrip('/')}/{name}")
            print(f"{name}: written to {args.out.rstrip('/')}/{name}")
        else:
            print(f"{name}: {df.count()} rows")
            df.show(5, truncate=False)
        cleanup_scratch(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
