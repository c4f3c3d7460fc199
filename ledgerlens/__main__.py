"""Command line: list and run queries, call endpoints, run a matching job, load a bulk file, refresh stored rollups, check freshness, census a table."""

from __future__ import annotations

import argparse
import json
from datetime import date

from ledgerlens.session import get_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerlens")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name, more in (("run", ["query"]), ("route", ["path"]), ("refresh-analytics", []), ("validate-freshness", []), ("census", ["table"]), ("match", ["job"]), ("feed", ["name"])):
        own = commands.add_parser(name)
        for x in more:
            own.add_argument(x)
        own.add_argument("--data", required=True)
        own.add_argument("--out")
        own.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
        own.add_argument("--params", default="{}", help="JSON object")
        own.add_argument("--today", default=date.today().isoformat())
    args = parser.parse_args(argv)
    from ledgerlens.plans.registry import QUERIES

    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = get_session()
    from ledgerlens import api
    from ledgerlens.sources import sinks

    ends = api.Api(spark, args.data)
    if args.command == "refresh-analytics":
        edges = ends.edges()
        for name, df in (("donor_committee", edges), ("donor_summary", api.rollups.donor_summary(edges)), ("donor_cycle", api.rollups.donor_cycle_summary(ends.receipts())), ("monthly", api.rollups.monthly_totals(ends.receipts(), ("committee_id",))), ("large", api.rollups.large_contributions(ends.receipts()))):
            sinks.write_table(df, f"{args.out}/{name}")
        return 0
    if args.command == "feed":
        from ledgerlens.sources import feeds

        for name, df in zip(("rows", "rejects"), feeds.load_feed(spark, args.data, args.name)):
            sinks.write_table(df, f"{args.out}/{name}")
        return 0
    if args.command == "match":
        df = ends.matches(args.job)
    elif args.command == "run":
        df = QUERIES[args.query](spark, args.data)
    elif args.command == "route":
        df = api.call(ends, args.path, **json.loads(args.params))
    elif args.command == "census":
        df = sinks.census(spark.read.parquet(f"{args.data}/{args.table}.parquet"))
    else:
        df = ends.freshness(date.fromisoformat(args.today))
        stale = df.first()["stale"]
        df.show(truncate=False)
        return int(stale)
    if args.out:
        {"parquet": sinks.write_table, "csv": sinks.write_csv, "json": sinks.write_json}[args.format](df, args.out)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
