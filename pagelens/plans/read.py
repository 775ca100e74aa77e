"""Read plans over an Audit: sets of rows for all sites at once, no query a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import urls as N
from pagelens.operators.findings import Audit, at_least, health, slice_of_page, touched
from pagelens.operators.tasks import build_tasks, task_order
from pagelens.plans.errors import BadInput, NoRuns, PageNotFound, PageSiteMismatch, RunNotFound, SiteNotFound

SITE = ["run_id", "site_id"]


def clamp(limit: int, most: int = D.PAGE_MOST) -> int:
    return max(1, min(most, limit))


def severity_counts(of: DataFrame, *keys: str) -> DataFrame:
    return of.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in D.SEVERITIES])


def site_rows(a: Audit) -> DataFrame:
    """Every site of every run: pages, findings, score, tasks, severities, and its first critical or high message."""
    tasks = build_tasks(a.findings).groupBy(*SITE).agg(F.count("*").alias("tasks"))
    top = a.findings.where(F.col("severity").isin("critical", "high")).groupBy(*SITE).agg(F.min_by("rule", F.struct("layer", D.rank(F.col("severity")), "finding_no")).alias("top_issue"))
    out = a.sites.join(health(a.findings, a.pages), SITE, "left").join(tasks, SITE, "left").join(severity_counts(a.findings, *SITE), SITE, "left").join(top, SITE, "left")
    return out.select(
        *SITE, "host", "state", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("tasks", F.lit(0)).alias("tasks"),
        *[F.coalesce(s, F.lit(0)).alias(s) for s in D.SEVERITIES], F.coalesce("top_issue", F.lit("")).alias("top_issue"),
    )


def site_order() -> list[Column]:
    return [(F.col("state") == "done").asc(), F.asc("score"), F.asc("site_id")]


def placed(df: DataFrame, order: list[Column], within: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """df with position: each row's place in this order."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))


def list_sites(a: Audit, run_id: int) -> DataFrame:
    """The sites of a run, those that aren't done first, then the lowest score; state in words, and the run's average score."""
    rows = site_rows(a).where(F.col("run_id") == run_id)
    average = rows.agg(F.bround(F.avg(F.when(F.col("state") == "done", F.col("score")))).cast("int").alias("average"))
    return placed(rows, site_order()).join(F.broadcast(average)).withColumn("state_label", D.pick(F.col("state"), D.STATES, ""))


def stored_order() -> list[Column]:
    """How a site's stored findings are read."""
    return [F.asc("layer"), F.asc("rule"), F.asc("url"), F.asc("finding_no")]


def run_order() -> list[Column]:
    """How all findings of a run are read."""
    return [F.asc("layer"), F.asc("origin"), F.asc("rule"), F.asc("url"), F.asc("site_id"), F.asc("finding_no")]


def severity_totals(a: Audit) -> DataFrame:
    """Of every run: how many findings of each severity that asks for work."""
    return a.findings.groupBy("run_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in D.SEVERITIES if s != "info"])


def list_runs(a: Audit, limit: int = D.RUNS_MOST) -> DataFrame:
    """Newest first: sites done and failed, pages, findings, tasks, severities, average scores (rounded, cut), worst site."""
    done = F.col("state") == "done"
    r = site_rows(a).groupBy("run_id").agg(
        F.count_if(done).alias("done"), F.count_if(F.col("state") == "error").alias("failed"), *[F.sum(c).cast("long").alias(c) for c in ("pages", "findings", "tasks", "critical", "high")],
        F.bround(F.avg(F.when(done, F.col("score")))).cast("int").alias("average"), F.floor(F.avg(F.when(done, F.col("score")))).cast("int").alias("average_cut"),
        F.min_by("host", F.when(done, F.struct("score", "site_id"))).alias("worst"),
    )
    return r.join(F.broadcast(a.runs), "run_id").orderBy(F.desc("run_id")).limit(clamp(limit, D.RUNS_MOST))


def run_summary(a: Audit) -> DataFrame:
    s = a.sites.groupBy("run_id").agg(F.count("*").alias("sites"), F.count_if(F.col("state") == "done").alias("sites_done"), F.count_if(F.col("state") == "error").alias("sites_failed"))
    p = a.pages.groupBy("run_id").agg(F.count_if(F.col("state") == "done").alias("pages_done"), F.count_if(F.col("state") == "queued").alias("pages_queued"))
    return s.join(p, "run_id").join(a.findings.groupBy("run_id").agg(F.count("*").alias("findings")), "run_id", "left")


def rule_frequency(a: Audit, run_id: int, top: int = 15) -> DataFrame:
    f = a.findings.where(F.col("run_id") == run_id).groupBy("rule").agg(F.countDistinct("site_id").alias("sites"), F.count("*").alias("findings"))
    return f.orderBy(F.desc("sites"), F.asc("rule")).limit(top)


def connected(a: Audit, search: str = "") -> DataFrame:
    """One row a host: its latest run's state, how often it ran, last seen; search is a plain part of the host."""
    s = a.sites.join(F.broadcast(a.runs), "run_id").withColumn("host", N.host_label("origin"))
    if search:
        s = s.where(F.contains(F.lower("host"), F.lit(search.lower())))
    latest = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("started_at"), F.desc("site_id")))
    return s.withColumn("rn", latest).groupBy("host").agg(
        F.max("started_at").alias("last_seen"), F.countDistinct("run_id").alias("runs"), F.max(F.when(F.col("rn") == 1, F.col("state"))).alias("state"), F.max(F.when(F.col("rn") == 1, F.col("site_id"))).alias("site_id")
    )


def connected_page(a: Audit, limit: int = D.PAGE_SIZE, offset: int = 0, search: str = "") -> DataFrame:
    """A page of connected sites: broken ones first, then the last seen, then by host; with the pages of the latest run."""
    rows = connected(a, search).orderBy((F.col("state") == "done").asc(), F.desc("last_seen"), F.asc("host")).offset(max(0, offset)).limit(clamp(limit))
    n = a.pages.groupBy("site_id").agg(F.count("*").alias("pages"))
    return rows.join(n, "site_id", "left").select("host", "last_seen", "runs", "state", F.coalesce("pages", F.lit(0)).alias("pages"))


def site_history(a: Audit, top: int = 12) -> DataFrame:
    """Of every host its latest runs with their scores."""
    h = a.sites.join(F.broadcast(a.runs), "run_id").join(health(a.findings, a.pages), SITE, "left")
    h = h.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("started_at"), F.desc("site_id"))))
    return h.where(F.col("rn") <= top).select("host", "run_id", F.col("rn").cast("long").alias("rn"), "state", "score")


def list_findings(a: Audit, run_id: int, min_severity: str = "info", page_url: str = "", limit: int = D.PAGE_SIZE) -> DataFrame:
    """Findings by layer and severity, each with its position and the total before the limit."""
    f = a.findings.where(F.col("run_id") == run_id).where(at_least(min_severity))
    f = slice_of_page(f, page_url) if page_url else f.withColumn("matched_via", F.lit(""))
    return _page(f, [F.asc("layer"), D.rank(F.col("severity")), F.asc("site_id"), F.asc("finding_no")], limit).select("site_id", "finding_no", "rule", "severity", "url", "matched_via", "position", "total")


def _page(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in this order with position and total; only these reach one task, the total is a count of its own."""
    first = df.orderBy(*order).limit(clamp(limit)).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
    return first.join(F.broadcast(df.agg(F.count("*").alias("total"))))


def list_tasks(a: Audit, run_id: int, min_severity: str = "medium", page_url: str = "", limit: int = D.PAGE_SIZE) -> DataFrame:
    """Tasks by severity and site, with position and total; with a page, those whose urls have it, whole, and the address that matched."""
    t = build_tasks(a.findings.where(F.col("run_id") == run_id), min_severity)
    key = N.same_key(F.lit(page_url))
    t = t.withColumn("matched", F.get(F.filter("urls", lambda u: N.same_key(u) == key), F.lit(0)) if page_url else F.lit(""))
    t = t.where("matched is not null") if page_url else t
    return _page(t, [D.rank(F.col("severity")), F.asc("host"), *task_order()[1:]], limit).withColumn("urls", F.slice("urls", 1, 20))


def site_detail(a: Audit, host: str) -> dict[str, DataFrame]:
    """A site's card: its latest state, history, severities, tasks in order, and the five pages in most need."""
    label = N.host_label(F.lit(host))
    rows = a.sites.join(F.broadcast(a.runs), "run_id").where(N.host_label("origin") == label)
    last = rows.orderBy(F.desc("started_at"), F.desc("site_id")).limit(1).select(*SITE)
    mine = lambda df: df.join(F.broadcast(last), SITE, "left_semi")
    pages = mine(site_pages(a, True)).orderBy("worst", F.desc("findings"), "page_url").limit(5)
    return {
        "site": mine(site_rows(a)).withColumn("state_label", D.pick(F.col("state"), D.STATES, "")),
        "history": site_history(a).where(N.host_label("host") == label).orderBy("rn"),
        "tasks": mine(build_tasks(a.findings)).orderBy(*task_order()).limit(D.PAGE_SIZE),
        "pages": pages,
    }


def site_previews(a: Audit, top: int = 5) -> DataFrame:
    """Of every site the pages in most need: by worst severity, number of findings and address."""
    return placed(site_pages(a, True).drop("position"), [F.asc("worst"), F.desc("findings"), F.asc("page_url"), F.asc("page_id")], tuple(SITE)).where(F.col("position") <= top)


def site_pages(a: Audit, only_issues: bool = False) -> DataFrame:
    """Every page with the findings that touch it and its position on its site's screen: the worst first, clean pages last. Each
    finding's addresses are exploded once and joined by key."""
    p = a.flat.select(*SITE, "page_id", "page_url", "page_key")
    t = a.findings.select(*SITE, "finding_no", "severity", F.explode(F.array_distinct(F.transform(touched(), lambda u: N.same_key(u)))).alias("page_key")).distinct()
    j = p.join(t, [*SITE, "page_key"], "left").groupBy(*SITE, "page_id", "page_url").agg(
        F.count("finding_no").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in D.SEVERITIES], F.min(F.when(F.col("severity").isNotNull(), D.rank(F.col("severity")))).alias("worst")
    )
    out = j.withColumn("worst", F.coalesce("worst", F.lit(99)))
    out = out.withColumn("position", F.row_number().over(Window.partitionBy(*SITE).orderBy("worst", "page_url", "page_id")).cast("long"))
    return out.where("findings > 0") if only_issues else out


def findings_by_layer(a: Audit) -> DataFrame:
    """Per run and layer: how many, and the rules in the order of their severity."""
    f = a.findings.groupBy("run_id", "layer", "rule", "severity").agg(F.count("*").alias("n"))
    s = F.array_sort(F.collect_list(F.struct(D.rank(F.col("severity")).alias("o"), "rule")))
    return f.groupBy("run_id", "layer").agg(F.sum("n").cast("long").alias("findings"), F.array_join(F.transform(s, lambda x: x.rule), ",").alias("rules"))


def sites_screen(a: Audit, run_id: int) -> DataFrame:
    return site_rows(a).where(F.col("run_id") == run_id).select("host", "critical", "high", (10 * F.col("critical") + F.col("high")).alias("pressure")).orderBy(F.desc("pressure"), F.asc("host"))


def find_page(a: Audit, run_id: int, page_url: str) -> DataFrame:
    """The first page with this address, scheme and host written in any way."""
    return a.flat.where((F.col("run_id") == run_id) & (F.col("page_key") == N.same_key(F.lit(page_url)))).orderBy("page_id").limit(1).select("site_id", "page_id", "page_url")


def known_page_urls(a: Audit, run_id: int, site_id: int, limit: int = 8) -> list[str]:
    rows = a.flat.where((F.col("run_id") == run_id) & (F.col("site_id") == site_id) & (F.col("page_url") != "")).groupBy("page_url").agg(F.min("page_id").alias("o")).orderBy("o").limit(limit)
    return [r.page_url for r in rows.collect()]


def resolve_run(a: Audit, run_id: int | None = None, host: str = "") -> int:
    """The run asked for, else the host's latest, else the latest; typed errors where there is none."""
    if run_id is not None:
        if a.runs.where(F.col("run_id") == run_id).isEmpty():
            raise RunNotFound(f"run {run_id}")
        return run_id
    runs = a.runs
    if host:
        label = F.lit(host)
        mine = a.sites.where(N.host_label("origin") == N.host_label(label)).select("run_id").distinct()
        own = runs.join(mine, "run_id", "left_semi").orderBy(F.desc("started_at"), F.desc("run_id")).first()
        if own:
            return own.run_id
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).first()
    if last is None:
        raise NoRuns("no audit has run yet")
    return last.run_id


def match_site(a: Audit, run_id: int, name: str) -> DataFrame:
    """The first site of the run with this name, or with a name that contains it."""
    label = N.host_label(F.lit(name))
    return a.sites.where((F.col("run_id") == run_id) & F.contains(N.host_label("origin"), label)).orderBy((N.host_label("origin") == label).desc(), "site_id").limit(1)


def resolve_page_site(a: Audit, run_id: int, page_url: str, site: str = "") -> int:
    """The site of a page; typed errors when the site asked for is another or the page isn't known."""
    own = match_site(a, run_id, site or page_url.split("://")[-1].split("/")[0]).first()
    if own is None:
        raise SiteNotFound(site or page_url)
    found = find_page(a, run_id, page_url).first()
    if found is None:
        raise PageNotFound(f"{page_url}; known: {', '.join(known_page_urls(a, run_id, own.site_id))}")
    if found.site_id != own.site_id:
        raise PageSiteMismatch(f"{page_url} is not of {site}")
    return own.site_id


def check_params(max_pages: int = 25, limit: int = 50, site_workers: int = 4, page_workers: int = 4, severity: str = "medium", hour: int = 0, search: str = "", offset: int = 0) -> None:
    """Ranges of the parameters of audits, lists, searches and schedules."""
    ranges = (("max_pages", max_pages, 1, 500), ("limit", limit, 1, 200), ("site_workers", site_workers, 1, 16), ("page_workers", page_workers, 1, 8), ("hour", hour, 0, 23), ("offset", offset, 0, 1 << 31))
    for name, value, low, high in ranges:
        if not low <= value <= high:
            raise BadInput(f"{name} must be {low} to {high}")
    if severity not in D.SEVERITIES:
        raise BadInput(f"severity must be one of {', '.join(D.SEVERITIES)}")
    if len(search) > 200:
        raise BadInput("search must have 200 characters at most")


def tolerant_json(text, schema: str) -> Column:
    """A JSON text as a struct; what can't be read is a struct of nulls."""
    return F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), schema))


def register_functions(spark) -> None:
    """The text and scoring functions under names for SQL, as expressions that the optimiser sees through."""
    rank = D.sql_case("s", {x: i for i, x in enumerate(D.SEVERITIES)}, "9")
    weight = D.sql_case("s", D.WEIGHT, "0")
    for signature, kind, body in (
        ("pl_collapse(x STRING)", "STRING", "trim(regexp_replace(coalesce(x, ''), '(?U)\\\\s+', ' '))"),
        ("pl_visible_len(x STRING)", "INT", "char_length(trim(regexp_replace(coalesce(x, ''), '(?U)\\\\s+', ' ')))"),
        ("pl_rank(s STRING)", "INT", rank), ("pl_weight(s STRING)", "INT", weight), ("pl_score(s STRING, effort INT)", "DOUBLE", f"({weight}) / greatest(1, effort)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
