"""Fetching, discovery, whole audits over a made-up network, sinks, screens, orders and the command line."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from pagelens import cli
from pagelens.operators.compare import compare_runs, morning_report, top_changes
from pagelens.operators.fixes import fixes_screen, only_ready
from pagelens.operators.tasks import build_tasks
from pagelens.plans import read as V
from pagelens.plans.errors import BadInput, NoSites, NothingToShow, RunAlreadyDone, RunNotFound
from pagelens.plans.run import audit_sites, resume_audit
from pagelens.plans.screens import SCREENS, screen, sidebar
from pagelens.sources import discovery as DS
from pagelens.sources import files as S
from pagelens.sources import http as H
from pagelens.sources import store
from test_engine import FOUND, finding


def test_charsets_and_bodies():
    assert H.charset_of("text/html; charset='UTF-8'", b"") == "utf-8"
    assert H.charset_of("text/html; charset=nonsense", b'<meta charset="windows-1251"/><meta name=x>') == "windows-1251"
    assert H.charset_of("", b"<meta content='text/html; charset=koi8-r'>") == "koi8-r" and H.charset_of("", b" " * 4096 + b'charset="koi8-r"') == "utf-8"
    assert H.unpacked(gzip.compress(b"x"), "gzip") == b"x" and H.unpacked(b"plain", "gzip") == b"plain"
    pack = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    assert H.unpacked(pack.compress(b"yy") + pack.flush(), "deflate") == b"yy"
    assert H.text_of("image/png", b"abc") == "" and H.text_of("text/plain", b"abc") == "abc" and H.text_of("", "é".encode()) == "é"
    assert H.busted("https://a/?q=1#f").startswith("https://a/?q=1&_ia=")


def test_tries_redirects_and_caps():
    slept, asked = [], []

    def transport(url, method, policy):
        asked.append(url)
        if url.endswith("/flaky") and len(asked) < 3:
            raise OSError("reset")
        if url.endswith("/busy"):
            return 503, {}, b"", url
        if url.endswith("/odd"):
            return 301, {"Location": "http://[bad"}, b"", url
        return 200, {"Content-Type": "text/html", "Location": "ignored"}, b"x" * 30, url

    get = lambda path, **k: H.fetch(f"https://a/{path}", H.Policy(body_most=20), transport, wait=slept.append, **k)
    row = get("flaky")
    assert row["ok"] and row["status"] == 200 and row["truncated"] and row["bytes"] == 20 and slept == [1.5, 2.25]
    asked.clear()
    assert get("busy")["status"] == 503 and len(asked) == 3
    assert not get("odd")["ok"] and "ValueError" in get("odd")["error"]
    paused = []
    get("x", pause=paused.append)
    assert paused == ["a"]


def test_robots_groups_delays_and_maps(spark):
    text = "User-agent: x\nSitemap: /s1\nUser-agent: Me\nDisallow: /a\nCrawl-delay: 2,5\nCrawl-delay: soon\nUser-agent: *\nDisallow: /\nDisallow:\nsitemap: https://b/s2 # two"
    files = spark.createDataFrame([("s", text), ("none", None)], "site string, text string")
    assert [tuple(r) for r in S.robots_rules(files, "me").collect()] == [("s", "/a", False)]
    assert [tuple(r) for r in S.robots_rules(files, "other").collect()] == [("s", "/", False)]
    assert [tuple(r) for r in S.robots_delays(files, "me").collect()] == [("s", 2.5)]
    assert [r.url for r in S.robots_sitemaps(files).orderBy("pos").collect()] == ["/s1", "https://b/s2"]


def test_links_to_unknown_pages(spark):
    known = spark.createDataFrame([("https://a.md", "https://a.md/x")], "site string, url string")
    hrefs = ["https://a.md/x#top", "https://www.a.md/y", "https://b.md/z", "https://a.md/p.pdf", "https://a.md/no", "https://a.md/y2", "https://www.a.md/y"]
    links = spark.createDataFrame([("https://a.md", 1, i, h) for i, h in enumerate(hrefs)], "site string, page_id long, pos int, href string")
    rules = spark.createDataFrame([("https://a.md", "/no", False)], "site string, pattern string, allow boolean")
    assert [(r.no, r.url) for r in DS.expand_by_links(known, links, rules).orderBy("no").collect()] == [(1, "https://www.a.md/y"), (2, "https://a.md/y2")]
    assert [r.url for r in DS.expand_by_links(known, links, rules, 1).collect()] == ["https://www.a.md/y"]


def net(url, method, policy):
    raise OSError("replaced below")


def made_up():
    def transport(url, method, policy):
        pages = {
            "https://a.md/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /closed\nSitemap: https://a.md/maps.xml"),
            "https://a.md/maps.xml": (200, "text/xml", "<sitemapindex><loc>https://a.md/m.xml</loc></sitemapindex>"),
            "https://a.md/m.xml": (200, "text/xml", "".join(f"<url><loc>https://a.md/{x}</loc></url>" for x in ("one", "closed/x", "two", "old"))),
            "https://a.md/": (200, "text/html", '<html lang="ro"><title>Home of everything that a.md has to offer</title><a href="/one">1</a>'),
            "https://a.md/one": (200, "text/html", '<title>One</title><a href="/">home</a><a href="/gone">gone</a>'),
            "https://a.md/two": (500, "text/html", "no"),
        }
        if url == "https://a.md/old":
            return 301, {"Location": "/one"}, b"", url
        status, kind, text = pages.get(url, (404, "text/html", ""))
        if url.startswith("https://lost.md"):
            raise OSError("no such host")
        return status, {"Content-Type": kind, "X-Cache": "HIT"}, text.encode(), url

    return transport


def test_audit_from_sites_to_findings(spark, tmp_path, capsys):
    (tmp_path / "sites.txt").write_text("# mine\na.md\nlost.md\n")
    how = H.AuditConfig(max_pages=4, policy=H.Policy(host_pause=0, retries=0))
    sites, heard, folder = S.read_site_list(spark, str(tmp_path / "sites.txt")), [], f"{tmp_path}/run"
    with pytest.raises(RunNotFound):
        resume_audit(spark, sites, folder)
    a = audit_sites(spark, sites, folder, config=how, transport=made_up(), on_event=lambda step, facts: heard.append((step, facts["resumed"])))
    assert [s for s, _ in heard] == ["responses", "queue", "loaded", "discovery", "pages", "sites", "flat", "findings"] and not any(again for _, again in heard)
    assert [r.url for r in a.pages.where("host = 'a.md'").orderBy("page_id").collect()] == [f"https://a.md/{x}" for x in ("", "one", "two", "old")]
    assert {(r.host, r.state) for r in a.sites.collect()} == {("a.md", "done"), ("lost.md", "error")}
    found = {(r.host, r.rule) for r in a.findings.collect()}
    assert {("a.md", "http.server_error"), ("a.md", "title.too_short"), ("lost.md", "http.unreachable"), ("lost.md", "sitemap.missing")} <= found
    with pytest.raises(RunAlreadyDone):
        resume_audit(spark, sites, folder)
    heard.clear()
    audit_sites(spark, sites, folder, config=how, transport=net, on_event=lambda step, facts: heard.append(facts["resumed"]))
    assert heard == [True] * 8  # nothing is loaded twice
    with pytest.raises(NoSites):
        audit_sites(spark, sites.limit(0), folder)
    # the command line reads what the run has stored
    assert cli.main(["tasks", folder], spark) == 0 and "Server error: 500" in capsys.readouterr().out
    assert cli.main(["export", folder, "--out", f"{tmp_path}/plan", "--today", "2026-08-01"], spark) == 0
    plan = spark.read.json(f"{tmp_path}/plan").orderBy("position").collect()
    assert plan[0].severity == "critical" and [r.position for r in plan] == list(range(1, len(plan) + 1))
    assert cli.main(["report", folder, "--out", f"{tmp_path}/reports"], spark) == 0
    assert "# a.md" in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/reports/sites").collect())
    assert cli.main(["tasks", f"{tmp_path}/nothing"], spark) == 2 and NothingToShow.code in capsys.readouterr().err
    assert build_tasks(a.findings).count() == spark.read.json(f"{tmp_path}/reports/tasks").count()
    # screens
    wants = {"site": {"host": "a.md"}, "pages": {"run_id": 1, "host": "a.md"}, "page": {"run_id": 1, "page_url": "https://a.md/two"}, "compare": {"before": 1, "after": 1}, "findings": {"run_id": 1}, "tasks": {"run_id": 1}}
    for name in SCREENS:
        assert screen(a, name, **wants.get(name, {})).count() >= 1, name
    assert [r.host for r in sidebar(a).collect()] == ["lost.md", "a.md"]
    assert [r.host for r in V.list_sites(a, 1).orderBy("position").collect()] == ["lost.md", "a.md"]
    assert V.list_findings(a, 1, limit=2).select("total").distinct().first().total == a.findings.count()
    with pytest.raises(BadInput):
        screen(a, "nothing")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([finding("a", "u1"), finding("b", "u2"), finding("a", "u1", run=2)], FOUND)
    store.replace_findings(rows, f"{tmp_path}/f")
    store.replace_findings(rows.where("run_id = 1 AND rule = 'a'"), f"{tmp_path}/f")
    assert sorted((r.run_id, r.rule) for r in spark.read.parquet(f"{tmp_path}/f").collect()) == [(1, "a"), (2, "a")]
    new = store.insert_new(spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id int, t string"), spark.createDataFrame([(1,)], "id int"), ["id"])
    assert [r.id for r in new.collect()] == [2]
    store.save_portfolio({"found": rows}, str(tmp_path), "me")
    assert store.load_portfolio(spark, str(tmp_path), "me", ["found"])["found"].count() == 3
    with pytest.raises(ValueError):
        store.portfolio_path("x", "../you")


def test_orders_of_changes_and_fixes(spark):
    rows = [finding("b", "https://a.md/1", "low", 1), finding("c", "https://a.md/2", "high", 2), finding("a", "https://a.md/3", "high", 3), finding("a", "https://a.md/4", "high", 1, run=2)]
    found = spark.createDataFrame(rows, FOUND)
    changes = compare_runs(found, 1, 2)
    got = [(r.kind, r.position, r.rule, r.total) for r in top_changes(changes, 2).orderBy("kind", "position").collect()]
    assert got == [("appeared", 1, "a", 1), ("fixed", 1, "a", 3), ("fixed", 2, "c", 3)]
    pages = spark.createDataFrame([("a.md", 1), ("a.md", 1), ("a.md", 2), ("one.md", 2)], "host string, run_id int")
    scores = spark.createDataFrame([("a.md", 1, 50), ("a.md", 2, 70)], "host string, run_id int, score int")
    assert "score up by 20" in morning_report(found, pages, scores, 1, 2).first().line and "fewer pages" in morning_report(found, pages, scores, 1, 2).first().line
    fixes = spark.createDataFrame([(1, 1, "u2", "f", False), (1, 1, "u1", "f", False), (1, 1, "u9", "f", True)], "run_id int, site_id long, url string, field string, ready boolean")
    assert [r.url for r in fixes_screen(fixes).orderBy("position").collect()] == ["u9", "u1", "u2"] and only_ready(fixes).count() == 1


def test_functions_for_sql_and_tolerant_json(spark):
    V.register_functions(spark)
    row = spark.sql("SELECT pl_collapse('  a   b ') AS c, pl_visible_len(NULL) AS n, pl_rank('high') AS r, pl_weight('none') AS w, pl_score('critical', 4) AS s").first()
    assert tuple(row) == ("a b", 0, 1, 0, 25.0)
    d = spark.createDataFrame([('{"section": "x"}',), ("{broken",), (None,)], "t string")
    assert [r[0].section for r in d.select(V.tolerant_json(F.col("t"), "section string")).collect()] == ["x", None, None]


def test_params_of_schedules_and_searches():
    V.check_params(hour=23, search="x", offset=0)
    for wrong in ({"hour": 24}, {"search": "x" * 201}, {"offset": -1}):
        with pytest.raises(BadInput):
            V.check_params(**wrong)
