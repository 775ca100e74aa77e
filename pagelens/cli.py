"""Command line: python -m pagelens.cli audit|resume|report|tasks|export FOLDER ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from pagelens.operators.findings import Audit
from pagelens.operators.tasks import build_tasks, ordered_plan, task_order, tracker_plan
from pagelens.plans.errors import AuditError, NothingToShow
from pagelens.plans.reports import write_reports
from pagelens.plans.run import audit_sites, resume_audit
from pagelens.sources.files import read_site_list
from pagelens.sources.http import AuditConfig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelens")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("audit", "resume"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--sites", required=True, help="a file with one site a line")
        c.add_argument("--max-pages", type=int, default=25)
    for name in ("report", "tasks", "export"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--out", required=name != "tasks")
        c.add_argument("--min-severity", default="medium")
        c.add_argument("--today", default="1970-01-01")
    return p


def stored_audit(spark: SparkSession, folder: str) -> Audit:
    """The tables that audit_sites() left in the folder."""
    try:
        sites, pages, flat, found = (spark.read.parquet(f"{folder}/{n}") for n in ("sites", "pages", "flat", "findings"))
    except Exception as e:
        raise NothingToShow(f"{folder} holds no finished run") from e
    runs = sites.select("run_id").distinct().selectExpr("run_id", "cast(0 as bigint) AS started_at", "'' AS label")
    return Audit(runs, sites, pages, flat, found)


def export_plan(a: Audit, min_severity: str, today: str) -> DataFrame:
    return ordered_plan(tracker_plan(build_tasks(a.findings, min_severity), today)).orderBy("run_id", "position")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **more) -> int:
    """0, or 2 with the error's code on stderr. more: passed to the audit (transport)."""
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pagelens").getOrCreate()
    try:
        if o.command in ("audit", "resume"):
            run = audit_sites if o.command == "audit" else resume_audit
            run(spark, read_site_list(spark, o.sites), o.folder, config=AuditConfig(max_pages=o.max_pages), on_event=lambda step, facts: print(step, facts["rows"]), **more)
            return 0
        a = stored_audit(spark, o.folder)
        if o.command == "report":
            write_reports(a, o.out)
        elif o.command == "tasks":
            for r in build_tasks(a.findings, o.min_severity).orderBy(*task_order()).limit(200).toLocalIterator():
                print(r.severity, r.title)
        else:
            export_plan(a, o.min_severity, o.today).write.mode("overwrite").json(o.out)
        return 0
    except AuditError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
