"""Robots.txt source as a table ``robots(host, robots_txt)``.

A crawl cluster would land fetched robots files in such a table (a fetch error or
a status >= 400 means no row, i.e. "allow all"). The test data has no robots
files, so ``derived_robots`` builds one per host of a page table by a fixed
rule; both the Spark query and its oracle derive the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textindex.functions import urls as U

# Fixed value: the agent whose robots group applies by default.
USER_AGENT = "MyCrawler/1.0 (+https://example.com/bot)"

# Robots.txt templates for derived hosts, chosen by
# length(host) % 6; template 5 means the host has no robots file.
ROBOTS_TEMPLATES = [
    "User-agent: *\n# c\nDisallow: /en/\nAllow: /en/7\nCrawl-delay: 2\n",
    ("User-agent: other\nDisallow: /\n\nUser-agent: " + USER_AGENT.lower() + "\n"
     "Disallow: /en/\nDisallow:\nDisallow: /fr/\nCrawl-delay: x\nCrawl-delay: 0.5\n\n"
     "User-agent: *\nDisallow: /\n"),
    "User-agent: *\r\nDisallow: /\r\n",
    ("User-agent: " + USER_AGENT + "\nDisallow:\n\nUser-agent: *\nDisallow: /es/\n"
     "Crawl-delay: 1.5\n"),
    ("User-agent: a\nUser-agent: " + USER_AGENT + "\nAllow: /de/1\nDisallow: /de/\n"
     "Disallow: /en/1\n   # indented comment\nnot a directive\nDisallow: *\n\n"
     "User-agent: *\nDisallow: /en/1\n"),
]
NO_ROBOTS_TEMPLATE = 5


def derived_robots(pages: DataFrame) -> DataFrame:
    """``robots(host, robots_txt)`` for the hosts of ``pages`` (see module doc)."""
    hosts = pages.select(U.hostname(F.col("url")).alias("host")).distinct()
    pick = F.pmod(F.length("host"), F.lit(6))
    txt = F.lit(None).cast("string")
    for i, t in reversed(list(enumerate(ROBOTS_TEMPLATES))):
        txt = F.when(pick == i, F.lit(t)).otherwise(txt)
    return hosts.filter(pick != NO_ROBOTS_TEMPLATE).select("host", txt.alias("robots_txt"))


def derived_robots_sql(pages: str = "pages") -> str:
    from textindex.plans.sqlparts import hostname, sql_str

    cases = " ".join(f"WHEN {i} THEN {sql_str(t)}" for i, t in enumerate(ROBOTS_TEMPLATES))
    return (f"SELECT host, CASE length(host) % 6 {cases} END AS robots_txt FROM "
            f"(SELECT DISTINCT {hostname('url')} AS host FROM {pages}) "
            f"WHERE length(host) % 6 <> {NO_ROBOTS_TEMPLATE}")
