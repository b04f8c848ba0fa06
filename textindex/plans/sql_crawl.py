"""DuckDB oracle SQL for robots rules, robots decisions and the crawl (unrolled BFS)."""

from __future__ import annotations

from textindex.plans import sqlparts as S
from textindex.sources.robots import USER_AGENT, derived_robots_sql

OWN, STAR = "own", "*"
NUMBER_RE = r"^[-+]?([0-9]+[.]?|[0-9]*[.][0-9]+)([eE][-+]?[0-9]+)?$"


def robots_ctes(user_agent: str = USER_AGENT) -> str:
    ua = user_agent.strip().lower()
    return f"""robots AS ({derived_robots_sql()}),
rlines AS (
  SELECT host, line_no, {S.trim_go('raw')} AS line FROM (
    SELECT host, CAST(unnest(range(0, len(parts))) AS INTEGER) AS line_no, unnest(parts) AS raw
    FROM (SELECT host, string_split(robots_txt, chr(10)) AS parts FROM robots))),
rfields AS (
  SELECT host, line_no, {S.trim_go("lower(split_part(line, ':', 1))")} AS field,
         {S.trim_go("regexp_extract(line, '^[^:]*:(.*)$', 1)")} AS value
  FROM rlines WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, ':')),
ragents AS (
  SELECT *, last_value(CASE WHEN field = 'user-agent' THEN lower(value) END IGNORE NULLS)
            OVER (PARTITION BY host ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent
  FROM rfields),
directives AS (
  SELECT host, line_no, field, value,
         CASE WHEN agent = {S.sql_str(ua)} THEN '{OWN}' WHEN agent = '*' THEN '{STAR}' END AS grp
  FROM ragents),
dir2 AS (
  SELECT *, max(CASE WHEN field = 'disallow' AND value = '' THEN line_no END)
            OVER (PARTITION BY host, grp) AS last_clear
  FROM directives WHERE grp IS NOT NULL AND field IN ('allow', 'disallow', 'crawl-delay')),
grules AS (
  SELECT host, grp, field AS kind, value AS pattern, line_no FROM dir2
  WHERE (field = 'disallow' AND starts_with(value, '/') AND line_no > coalesce(last_clear, -1))
     OR (field = 'allow' AND starts_with(value, '/'))),
gdelays AS (
  SELECT host, grp, arg_max(CAST(value AS DOUBLE), line_no) AS crawl_delay FROM dir2
  WHERE field = 'crawl-delay' AND regexp_matches(value, {S.sql_str(NUMBER_RE)})
  GROUP BY host, grp),
own_hosts AS (
  SELECT host FROM grules WHERE grp = '{OWN}'
  UNION SELECT host FROM gdelays WHERE grp = '{OWN}' AND crawl_delay > 0),
chosen AS (
  SELECT host, CASE WHEN host IN (SELECT host FROM own_hosts) THEN '{OWN}' ELSE '{STAR}' END AS grp
  FROM (SELECT DISTINCT host FROM robots)),
applied_rules AS (SELECT g.* FROM grules g SEMI JOIN chosen c ON g.host = c.host AND g.grp = c.grp),
applied_delays AS (
  SELECT c.host, c.grp, coalesce(d.crawl_delay, 0.0) AS crawl_delay
  FROM chosen c LEFT JOIN gdelays d ON c.host = d.host AND c.grp = d.grp)"""


def decision_sql(targets: str, key: str, mode: str = "reference") -> str:
    """SELECT over ``targets`` adding host, robots_path, allowed, crawl_delay."""
    allowed = ("(m._allow IS NOT NULL OR m._disallow IS NULL)" if mode == "reference"
               else "(coalesce(m._allow, -1) >= coalesce(m._disallow, -1))")
    return f"""(WITH t AS (SELECT *, {S.hostname('url')} AS host, {S.robots_path('url')} AS robots_path
                FROM {targets}),
     m AS (SELECT t.{key} AS _k,
                  max(CASE WHEN r.kind = 'allow' THEN length(r.pattern) END) AS _allow,
                  max(CASE WHEN r.kind = 'disallow' THEN length(r.pattern) END) AS _disallow
           FROM t JOIN applied_rules r ON t.host = r.host AND starts_with(t.robots_path, r.pattern)
           GROUP BY t.{key})
SELECT t.*, {allowed} AS allowed, coalesce(d.crawl_delay, 0.0) AS crawl_delay
FROM t LEFT JOIN m ON t.{key} = m._k LEFT JOIN applied_delays d ON t.host = d.host)"""


# The binary tree of each host's pages that the crawl queries add to their html.
LINKED = f"""numbered AS (
  SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY url) AS n
  FROM (SELECT DISTINCT {S.hostname('url')} AS host, url FROM pages)),
more AS (
  SELECT p.url, string_agg(a, '' ORDER BY a) AS links FROM (
    SELECT host, n // 2 AS n, '<a href=' || chr(39) || regexp_replace(url, '^https?://[^/]*', '')
           || chr(39) || '>more</a>' AS a FROM numbered) c
  JOIN numbered p ON p.host = c.host AND p.n = c.n GROUP BY p.url),
linked AS (
  SELECT page_id, pages.url, html || coalesce(links, '') AS html FROM pages LEFT JOIN more ON more.url = pages.url)"""


def crawl_ctes(max_depth: int, seeds: str = "SELECT url FROM numbered WHERE n = 1") -> str:
    """Unrolled BFS: f{d} frontier, r{d} report rows, for d = 0..max_depth."""
    parts = [robots_ctes(), LINKED,
             """snap AS (SELECT url, html, 200 AS status_code, true AS found FROM (
  SELECT url, html, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS rn FROM linked)
  WHERE rn = 1)""",
             f"f0 AS (SELECT url, 0 AS depth FROM ({seeds}))",
             "v0 AS (SELECT url FROM f0)"]
    for d in range(max_depth + 1):
        parts.append(f"""r{d} AS (
  SELECT x.url, x.depth, x.allowed, coalesce(s.found, false) AS found,
         CASE WHEN x.allowed AND coalesce(s.found, false) THEN s.status_code END AS status_code,
         CASE WHEN x.allowed AND coalesce(s.found, false) THEN {S.html_title('s.html')} END AS title,
         CASE WHEN NOT x.allowed THEN 'BLOCKED' WHEN NOT coalesce(s.found, false) THEN 'MISSING'
              WHEN s.status_code >= 400 THEN 'ERROR ' || CAST(s.status_code AS VARCHAR)
              ELSE 'OK' END AS status,
         x.crawl_delay, x.host, s.html
  FROM {decision_sql(f'f{d}', 'url')} x LEFT JOIN snap s ON x.url = s.url)""")
        if d < max_depth:
            parts.append(f"""l{d + 1} AS (
  SELECT DISTINCT link AS url FROM (
    SELECT base, {S.resolve('base', 'href')} AS link FROM (
      SELECT url AS base, unnest({S.hrefs('html')}) AS href FROM r{d}
      WHERE allowed AND found))
  WHERE link IS NOT NULL AND link <> '' AND {S.is_valid('link')} AND {S.hostname('link')} = {S.hostname('base')}),
f{d + 1} AS (SELECT url, {d + 1} AS depth FROM l{d + 1} WHERE url NOT IN (SELECT url FROM v{d})),
v{d + 1} AS (SELECT url FROM v{d} UNION ALL SELECT url FROM f{d + 1})""")
    parts.append("report AS (" + " UNION ALL ".join(
        f"SELECT url, depth, allowed, found, status_code, title, status, crawl_delay, host FROM r{d}"
        for d in range(max_depth + 1)) + ")")
    return "WITH " + ",\n".join(parts)
