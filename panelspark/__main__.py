"""Rebuild all views and marts from landed snapshots and run the not-null tests.

    spark-submit -m panelspark --annual PATH --quarterly PATH --output PATH

Exits with 1 if a test finds a NULL, and with 2, before anything is built, if the newest
annual snapshot has lost the total series.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from .operators import ObservedChecks
from .plans.build import (
    RAW_ANNUAL, RAW_QUARTERLY, build_annual, build_quarterly, build_report, total_is_lost,
)
from .plans.specs import ANNUAL, QUARTERLY
from .session import panel_session
from .sources import open_snapshots, publish_view


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="panelspark", description=__doc__.splitlines()[0])
    parser.add_argument("--annual", required=True, help="root of the annual snapshots")
    parser.add_argument("--quarterly", required=True, help="root of the quarterly snapshots")
    parser.add_argument("--output", required=True, help="folder for the mart tables")
    parser.add_argument("--date", default="latest", help="snapshot date, by default the newest")
    parser.add_argument("--buckets", type=int, help="bucket the stocks and service marts by entity instead of clustering them")
    args = parser.parse_args(argv)

    spark = panel_session("panelspark build")
    publish_view(open_snapshots(spark, args.annual, args.date), RAW_ANNUAL)
    publish_view(open_snapshots(spark, args.quarterly, args.date), RAW_QUARTERLY)
    panel, sheet = replace(ANNUAL, one_snapshot=True), replace(QUARTERLY, one_snapshot=True)
    if total_is_lost(spark, panel):
        print(f"FAIL the snapshot has no row of series {panel.total_series}")
        return 2
    checks = ObservedChecks()
    build_annual(spark, panel, root=args.output, checks=checks, buckets=args.buckets)
    build_quarterly(spark, sheet, root=args.output, checks=checks, buckets=args.buckets)
    for line in build_report(spark, panel).toLocalIterator():
        print(f"{'note' if line.failures else 'ok'} {line.check}: {line.failures}")
    failed = 0
    for line in checks.results(spark).toLocalIterator():
        failed += line.failures > 0
        print(f"{'FAIL' if line.failures else 'ok'} {line.table}.{line.column}: {line.failures} of {line.rows} NULL")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
