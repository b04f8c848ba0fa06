"""Breadth-first crawl over an inline site snapshot."""

from textindex.operators.crawl import crawl, crawl_schedule, crawl_summary

H = "https://site.example.com"


def page(title, *links):
    a = "".join(f'<a href="{l}">x</a>' for l in links)
    return f"<html><head><title>{title}</title></head><body><p>text</p>{a}</body></html>"


SITE = [
    (H + "/", page("Home", "/a", "/b", "/#top", "https://elsewhere.example.org/x", "mailto:x@y"), 200),
    (H + "/a", page("A", "/a/deep", "/", "/private/p"), 200),
    (H + "/b", page("B", "/missing", "/gone"), 200),
    (H + "/a/deep", page("Deep", "/a/deeper"), 200),
    (H + "/a/deeper", page("Deeper"), 200),
    (H + "/gone", page("Gone"), 404),
    (H + "/private/p", page("Private"), 200),
]


def _run(spark, max_depth):
    pages = spark.createDataFrame(SITE, "url string, html string, status_code int")
    robots = spark.createDataFrame([("site.example.com", "User-agent: *\nDisallow: /private/\nCrawl-delay: 1")],
                                   "host string, robots_txt string")
    seeds = spark.createDataFrame([(H + "/",), (H + "/",)], "url string")
    return crawl(seeds, pages, robots, max_depth=max_depth)


def test_bfs_depths_and_status(spark):
    res = _run(spark, 2)
    rep = {r.url: (r.depth, r.status, r.title) for r in res.report.collect()}
    assert rep[H + "/"] == (0, "OK", "Home")
    assert rep[H + "/#top"][0] == 1           # fragment makes a distinct URL
    assert rep[H + "/a"][:2] == (1, "OK")
    assert rep[H + "/a/deep"][:2] == (2, "OK")
    assert H + "/a/deeper" not in rep          # beyond max depth
    assert rep[H + "/private/p"][:2] == (2, "BLOCKED")
    assert rep[H + "/gone"][:2] == (2, "ERROR 404")
    assert rep[H + "/missing"][:2] == (2, "MISSING")
    assert not any("elsewhere" in u or u.startswith("mailto") for u in rep)
    assert len(rep) == res.report.count()      # every URL once, at its minimum depth
    summary = {r.status: r.n_pages for r in crawl_summary(res.report).collect()}
    assert summary["BLOCKED"] == 1 and summary["ERROR 404"] == 1


def test_schedule_offsets(spark):
    res = _run(spark, 1)
    sched = {r.url: r.fetch_offset_s for r in crawl_schedule(res.report).collect()}
    assert sorted(sched.values()) == [float(i) for i in range(len(sched))]
    assert sched[H + "/"] == 0.0


def test_stops_at_an_empty_frontier(spark):
    res = _run(spark, 9)
    depths = {r.url: r.depth for r in res.frontier.collect()}
    assert depths[H + "/a/deeper"] == 3 and max(depths.values()) == 3
