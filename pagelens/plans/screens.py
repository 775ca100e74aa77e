"""The screens: every name is a plan over an Audit, built from the read plans; nothing heavy is planned before it is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import text as T
from pagelens.operators.compare import compare_runs, top_changes
from pagelens.operators.findings import Audit
from pagelens.operators.fixes import fix_plan, fixes_screen
from pagelens.operators.tasks import build_tasks
from pagelens.plans import read as V
from pagelens.plans import reports as R
from pagelens.plans.errors import BadInput


def tasks_screen(a: Audit, run_id: int, top: int = 60) -> DataFrame:
    t = build_tasks(a.findings.where(F.col("run_id") == run_id))
    return t.orderBy(D.rank(F.col("severity")), "origin", "rule", "subject").limit(top).withColumn("short", T.shorten_right("title", 60))


def pages_screen(a: Audit, run_id: int, host: str) -> DataFrame:
    own = V.match_site(a, run_id, host).select("run_id", "site_id")
    pages = V.site_pages(a).join(F.broadcast(own), ["run_id", "site_id"], "left_semi")
    return pages.withColumn("short", T.shorten_left("page_url", 48)).orderBy("position")


def compare_screen(a: Audit, before: int, after: int, top: int = 25) -> DataFrame:
    return top_changes(compare_runs(a.findings, before, after), top).orderBy("kind", "position")


SCREENS: dict[str, Callable[..., DataFrame]] = {
    "sites": lambda a, **k: V.connected_page(a, **k),
    "add": lambda a, **k: V.connected(a).select(F.count("*").alias("hosts")),
    "site": lambda a, host, part="site", **k: V.site_detail(a, host)[part],
    "pages": lambda a, run_id, host, **k: pages_screen(a, run_id, host),
    "page": lambda a, run_id, page_url, **k: V.list_findings(a, run_id, "info", page_url, D.PAGE_MOST),
    "fixes": lambda a, **k: fixes_screen(fix_plan(a.findings, a.flat)),
    "compare": lambda a, before, after, **k: compare_screen(a, before, after),
    "schedule": lambda a, **k: a.runs.orderBy(F.desc("started_at")),
    "findings": lambda a, run_id, **k: V.sites_screen(a, run_id),
    "tasks": lambda a, run_id, **k: tasks_screen(a, run_id),
    "portfolio": lambda a, **k: R.portfolio_report(a),
}


def screen(a: Audit, name: str, **parameters) -> DataFrame:
    if name not in SCREENS:
        raise BadInput(f"no screen {name!r}; there are {', '.join(SCREENS)}")
    return SCREENS[name](a, **parameters)


def sidebar(a: Audit, most: int = D.PAGE_SIZE) -> DataFrame:
    """Hosts and states only: what is shown before anything heavy is read."""
    return V.connected(a).select("host", "state", "last_seen").orderBy((F.col("state") == "done").asc(), F.desc("last_seen"), "host").limit(most)
