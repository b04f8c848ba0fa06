"""Robots parsing and decisions on inline robots files (2.5 of the survey)."""

from textindex.operators.robots import host_rules, robots_decision, robots_rules
from textindex.sources.robots import USER_AGENT

UA = USER_AGENT.lower()
ROBOTS = [
    ("spam-farm.example.org", "User-agent: *\n# c\nDisallow: /en/\nAllow: /en/7\nCrawl-delay: 2"),
    ("thther.example.org", "User-agent: other\nDisallow: /\n\nUser-agent: " + UA + "\n"
     "Disallow: /en/\nDisallow:\nDisallow: /fr/\nCrawl-delay: x\nCrawl-delay: 0.5\n\n"
     "User-agent: *\nDisallow: /"),
    ("blog.tionsh.example.net", "User-agent: *\nDisallow: /"),
    ("empty-own.example.com", "User-agent: " + USER_AGENT + "\nDisallow:\n\nUser-agent: *\nDisallow: /x/"),
    ("stacked.example.com", "User-agent: " + UA + "\nUser-agent: someone-else\nDisallow: /a/\n\n"
     "User-agent: *\nDisallow: /b/"),
    ("modes.example.com", "User-agent: *\nAllow: /p\nDisallow: /p/q"),
]
URLS = [
    (1, "https://spam-farm.example.org/en/1"),       # blocked by /en/
    (2, "https://spam-farm.example.org/en/7?x=1"),   # allowed by /en/7
    (3, "https://thther.example.org/en/2"),          # /en/ cleared by the empty Disallow
    (4, "https://thther.example.org/fr/2"),          # own group /fr/
    (5, "https://blog.tionsh.example.net/any"),      # * Disallow: /
    (6, "https://blog.tionsh.example.net"),          # bare host: path "" is not under "/"
    (7, "https://empty-own.example.com/x/1"),        # own group empty -> * applies
    (8, "https://stacked.example.com/a/1"),          # only the last stacked agent counts -> * group
    (9, "https://stacked.example.com/b/1"),
    (10, "https://modes.example.com/p/q/r"),         # allow /p (short) vs disallow /p/q (long)
    (11, "https://no-robots.example.com/anything"),  # no robots row -> allowed
    (12, "https://spam-farm.example.org/%65n/1"),    # rules see the decoded path
]


def _decide(spark, mode="reference"):
    robots = spark.createDataFrame(ROBOTS, "host string, robots_txt string")
    targets = spark.createDataFrame(URLS, "id int, url string")
    out = robots_decision(targets, host_rules(robots), mode=mode).collect()
    return {r.id: (r.allowed, r.crawl_delay) for r in out}


def test_reference_mode(spark):
    d = _decide(spark)
    assert {k: v[0] for k, v in d.items()} == {
        1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 8: True, 9: False,
        10: True, 11: True, 12: False}
    assert d[1][1] == 2.0 and d[3][1] == 0.5 and d[11][1] == 0.0


def test_longest_mode_differs_on_short_allow(spark):
    d = _decide(spark, "longest")
    assert d[10][0] is False
    assert d[2][0] is True


def test_rules_of_chosen_group(spark):
    robots = spark.createDataFrame(ROBOTS, "host string, robots_txt string")
    hosts = host_rules(robots)
    got = {(r.host, r.grp, r.kind, r.pattern) for r in robots_rules(hosts).collect()}
    assert ("thther.example.org", "own", "disallow", "/fr/") in got
    assert ("thther.example.org", "own", "disallow", "/en/") not in got
    assert ("empty-own.example.com", "*", "disallow", "/x/") in got
    assert {(r.host, r.grp) for r in hosts.collect()} >= {("thther.example.org", "own"),
                                                          ("spam-farm.example.org", "*")}


def test_decision_is_one_join_on_host(spark):
    robots = spark.createDataFrame(ROBOTS, "host string, robots_txt string")
    targets = spark.createDataFrame(URLS, "id int, url string")
    plan = robots_decision(targets, host_rules(robots))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
