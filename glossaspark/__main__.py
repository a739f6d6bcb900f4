"""Command line: ``python -m glossaspark COMMAND``.

doctor                         versions
scan PROJECT                   texts of a project, as JSON lines
extract PROJECT [-o FILE]      segments, as JSON lines; exit 3 when FILE exists
check PROJECT TEMPLATES LANG   cross-check with official templates; exit 4 when they differ

Exit 2 for wrong input. On a cluster use the functions; this is for one project.
"""

from __future__ import annotations

import argparse
import os
import sys

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import localize
from .session import session
from .sources import projects, templates


def _printed(df: DataFrame, out) -> None:
    for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).toLocalIterator():
        print(row["line"], file=out)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glossaspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor")
    commands.add_parser("scan").add_argument("project")
    extract = commands.add_parser("extract")
    extract.add_argument("project")
    extract.add_argument("-o", "--output")
    check = commands.add_parser("check")
    for name in ("project", "templates", "language"):
        check.add_argument(name)
    args = parser.parse_args(arguments)
    if args.command == "doctor":
        print(f"python {sys.version.split()[0]}, pyspark {pyspark.__version__}")
        return 0
    if not os.path.isdir(args.project):
        print(f"no folder: {args.project}", file=sys.stderr)
        return 2
    if args.command == "extract" and args.output and os.path.exists(args.output):
        print(f"exists: {args.output}", file=sys.stderr)
        return 3
    spark = session(master=os.environ.get("SPARK_MASTER", "local[*]"), spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    if args.command == "scan":
        good, bad = projects.scan(spark, args.project)
        _printed(good.orderBy(projects.by_parts(F.col("path"))), sys.stdout)
        _printed(bad.orderBy("path"), sys.stderr)
        return 0
    segments = localize.extracted(spark, args.project)
    if args.command == "extract":
        ordered = segments.orderBy(projects.by_parts(F.col("source_file")), "line_number")
        if not args.output:
            _printed(ordered, sys.stdout)
            return 0
        with open(args.output, "x", encoding="utf-8") as out:
            _printed(ordered, out)
        return 0
    entries, _ = templates.entries(spark, args.templates, args.language)
    report = localize.crosschecked(segments, entries, localize.mapped(segments, entries))
    _printed(report, sys.stdout)
    return 0 if report.first()["matches"] else 4


if __name__ == "__main__":
    sys.exit(main())
