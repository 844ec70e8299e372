"""Command line: python -m proofmill.cli check PATH."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__
from .plans import report


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="proofmill")
    p.add_argument("--version", action="version", version=__version__)
    c = p.add_subparsers(dest="command", required=True).add_parser("check")
    c.add_argument("path")
    c.add_argument("--only", help="comma-separated checks")
    c.add_argument("--registry")
    c.add_argument("--records", help="Parquet table of recorded metadata for the citation check")
    c.add_argument("--cited", help="Parquet table of cited sources for the support check")
    c.add_argument("--replies", help="Parquet table of recorded model replies for the support check")
    c.add_argument("--offline", action="store_true", help="leave the recorded tables out")
    c.add_argument("--json", action="store_true")
    c.add_argument("--out", help="folder for the JSON report as part files, in place of standard output")
    c.add_argument("--show-verified", action="store_true")
    c.add_argument("--show-unverifiable", action="store_true")
    c.add_argument("--top", type=int)
    c.add_argument("--strict", action="store_true")
    c.add_argument("--max-urls", type=int, default=60)
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--fail-on", choices=["flagged", "unverifiable", "never"], default="flagged")
    c.add_argument("--exit-zero", action="store_true")
    a = p.parse_args(argv)
    why = "--top needs a positive number" if a.top is not None and a.top < 1 else "--top and --json exclude each other" if a.top and a.json else "--replies needs support among --only" if a.replies and "support" not in (a.only or "").split(",") else None if os.path.exists(a.path) or "://" in a.path else f"{a.path} does not exist"
    if why:
        print(report.error_json(why) if a.json else why, file=sys.stdout if a.json else sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .plans.audit import ALL, audit

    spark = SparkSession.builder.appName("proofmill").getOrCreate()
    only = a.only.split(",") if a.only else None
    recorded = lambda path: spark.read.parquet(path) if path and not a.offline else None
    try:
        found = audit(spark, a.path, only, recorded(a.records), a.strict, a.exclude, a.registry, a.max_urls, recorded(a.cited), recorded(a.replies)).cache()
    except ValueError as e:
        print(report.error_json(str(e)) if a.json else e, file=sys.stdout if a.json else sys.stderr)
        return 2
    show = ("FLAGGED", *(("VERIFIED",) if a.show_verified else ()), *(("UNVERIFIABLE",) if a.show_unverifiable else ()))
    if a.json and a.out:
        report.write_json_report(found, only or ALL, a.out)
        return 0 if a.exit_zero else report.exit_code(found, a.fail_on)
    print(report.json_report(found, only or ALL) if a.json else report.top_report(found, a.top) if a.top else report.text_report(found, only or ALL, show))
    return 0 if a.exit_zero else report.exit_code(found, a.fail_on)


if __name__ == "__main__":
    sys.exit(main())
