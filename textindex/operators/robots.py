"""Robots.txt rules and decisions as relational jobs.

One robots file is one row, so it is parsed inside the row: lines are split and
folded into the rules of two groups (ours and ``*``), of which one applies. A
host's rules are one row of arrays, bounded by its file, and targets meet them in
a single join on ``host``, which Spark splits where a host has very many targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textindex.functions import urls as U
from textindex.functions.text import trim_go
from textindex.sources.robots import USER_AGENT

# A crawl-delay value that parses as a decimal number.
NUMBER_RE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
OWN, STAR = "own", "*"
_RULES = "array<struct<pattern:string,line_no:int>>"


def _directives(text: Column) -> Column:
    """Array of (line_no, field, value): blank and ``#`` lines and lines without a
    colon are dropped; inline comments are not stripped."""
    lines = F.transform(F.split(text, "\n"), lambda raw, i: F.struct(
        i.alias("line_no"), trim_go(raw).alias("line")))
    kept = F.filter(lines, lambda x: (x["line"] != "") & ~x["line"].startswith("#")
                    & x["line"].contains(":"))
    return F.transform(kept, lambda x: F.struct(
        x["line_no"].alias("line_no"),
        trim_go(F.lower(F.substring_index(x["line"], ":", 1))).alias("field"),
        trim_go(F.regexp_extract(x["line"], r"^[^:]*:(.*)$", 1)).alias("value")))


def _group(allow: Column, disallow: Column, delay: Column) -> Column:
    return F.struct(allow.alias("allow"), disallow.alias("disallow"), delay.alias("delay"))


def _add(group: Column, x: Column) -> Column:
    """A group after one directive; an empty Disallow clears the earlier ones."""
    rule = F.array(F.struct(x["value"].alias("pattern"), x["line_no"].alias("line_no")))
    path = x["value"].startswith("/")
    return _group(
        F.when((x["field"] == "allow") & path, F.concat(group["allow"], rule))
        .otherwise(group["allow"]),
        F.when((x["field"] == "disallow") & (x["value"] == ""), F.array().cast(_RULES))
        .when((x["field"] == "disallow") & path, F.concat(group["disallow"], rule))
        .otherwise(group["disallow"]),
        F.when((x["field"] == "crawl-delay") & x["value"].rlike(NUMBER_RE),
               x["value"].try_cast("double")).otherwise(group["delay"]))


def host_rules(robots: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """C14: ``(host, grp, allow, disallow, crawl_delay)``, one row per robots file.

    ``allow`` and ``disallow`` are arrays of (pattern, line_no). The current agent is
    the latest ``user-agent`` line above, so only the last of a stacked group counts.
    Our own group applies when it has any rule or a positive delay, else ``*``.
    """
    ua = user_agent.strip().lower()
    none = _group(F.array().cast(_RULES), F.array().cast(_RULES), F.lit(None).cast("double"))
    start = F.struct(F.lit("").alias("agent"), none.alias("own"), none.alias("star"))

    def step(acc: Column, x: Column) -> Column:
        is_agent = x["field"] == "user-agent"
        return F.struct(
            F.when(is_agent, F.lower(x["value"])).otherwise(acc["agent"]).alias("agent"),
            F.when(~is_agent & (acc["agent"] == F.lit(ua)), _add(acc["own"], x))
            .otherwise(acc["own"]).alias("own"),
            F.when(~is_agent & (acc["agent"] == F.lit(STAR)), _add(acc["star"], x))
            .otherwise(acc["star"]).alias("star"))

    parsed = robots.select("host", F.aggregate(
        _directives(F.coalesce("robots_txt", F.lit(""))), start, step).alias("g"))
    own = F.col("g.own")
    applies = ((F.size(own["allow"]) > 0) | (F.size(own["disallow"]) > 0)
               | (F.coalesce(own["delay"], F.lit(0.0)) > 0))
    chosen = parsed.select("host", F.when(applies, F.lit(OWN)).otherwise(F.lit(STAR)).alias("grp"),
                           F.when(applies, own).otherwise(F.col("g.star")).alias("g"))
    return chosen.select("host", "grp", "g.allow", "g.disallow",
                         F.coalesce("g.delay", F.lit(0.0)).alias("crawl_delay"))


def robots_rules(hosts: DataFrame) -> DataFrame:
    """``(host, grp, kind, pattern, line_no)``: the rules of ``host_rules``, a row each."""
    def kind(name: str) -> Column:
        return F.transform(name, lambda r: F.struct(
            F.lit(name).alias("kind"), r["pattern"].alias("pattern"), r["line_no"].alias("line_no")))

    return (hosts.select("host", "grp", F.explode(F.concat(kind("allow"), kind("disallow"))).alias("r"))
            .select("host", "grp", "r.kind", "r.pattern", "r.line_no"))


def robots_decision(targets: DataFrame, hosts: DataFrame, url_col: str = "url",
                    mode: str = "reference") -> DataFrame:
    """E5 + F7: add ``host``, ``robots_path``, ``allowed`` and ``crawl_delay``.

    ``mode="reference"``: any matching Allow wins, else any matching Disallow
    blocks. ``mode="longest"``: the longest match wins, Allow on ties.
    Matching is a prefix test on the decoded path; ``*`` and ``$`` are literal
    characters. Hosts without robots rules are allowed with no delay.
    """
    if mode not in ("reference", "longest"):
        raise ValueError(f"unknown robots mode {mode!r}")

    def longest(rules: str) -> Column:
        """Length of the longest matching rule, -1 without any."""
        hits = F.filter(rules, lambda r: F.col("robots_path").startswith(r["pattern"]))
        return F.coalesce(F.array_max(F.transform(hits, lambda r: F.length(r["pattern"]))), F.lit(-1))

    t = (targets.withColumn("host", U.hostname(F.col(url_col)))
         .withColumn("robots_path", U.robots_path(F.col(url_col))))
    allow, disallow = longest("_allow"), longest("_disallow")
    allowed = ((allow >= 0) | (disallow < 0)) if mode == "reference" else (allow >= disallow)
    rules = hosts.select(F.col("host").alias("_host"), F.col("allow").alias("_allow"),
                         F.col("disallow").alias("_disallow"), "crawl_delay")
    return (t.join(rules, F.col("host") == F.col("_host"), "left")
            .withColumn("allowed", allowed)
            .withColumn("crawl_delay", F.coalesce(F.col("crawl_delay"), F.lit(0.0)))
            .drop("_host", "_allow", "_disallow"))
