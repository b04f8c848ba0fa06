"""Registered queries: each reads the data folder's tables and returns a DataFrame.

``QUERIES[name](spark, sf_dir)`` is the Spark plan; ``ORACLES[name]`` is the
DuckDB SQL over the same parquet tables. Computed columns carry the
same aliases on both sides; arrays are compared as joined strings and scores
rounded to six places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.functions import text as T
from textindex.functions.stopwords import ENGLISH, SPANISH, language_column
from textindex.operators.analyze import analyze
from textindex.operators.index import build_index, build_postings
from textindex.operators.search import (batch_search, cursor, score_documents, search, search_after,
                                        search_envelope, search_total)
from textindex.plans import sqlparts as S
from textindex.session import ensure_checkpoint_dir
from textindex.sources.tables import corpus_documents, read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Search parameters of the checked queries (terms in neither stopword list,
# present at every scale).
QUERY_TEXT = "thre ing ble"
REPEATED_QUERY_TEXT = "thre thre ing ble"
LOOKUP_TERMS = ("thre", "ing", "ble")


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def corpus_index(spark: SparkSession, sf_dir: str, **kwargs):
    return build_index(corpus_documents(spark, sf_dir), text_col="content", **kwargs)


def joined(col) -> F.Column:
    return F.concat_ws(" ", col)


def joined_ints(col) -> F.Column:
    return F.concat_ws(",", F.transform(col, lambda x: x.cast("string")))


# --------------------------------------------------------------------------
# Text analysis
# --------------------------------------------------------------------------

@register("tokenize", f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {S.tokens('text')} AS toks FROM documents)""")
def q_tokenize(spark, sf_dir):
    toks = T.tokenize("text")
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.size(toks).cast("bigint").alias("n_tokens"), joined(toks).alias("tokens"))


@register("normalize", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT doc_id, {S.normalized('text')} AS t FROM documents)""")
def q_normalize(spark, sf_dir):
    t = T.normalize(T.tokenize("text"))
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.size(t).cast("bigint").alias("n_terms"), joined(t).alias("terms"))


def _stopword_query(language):
    def fn(spark, sf_dir):
        t = T.analyzed_terms(F.col("text"), language=language)
        return read_table(spark, sf_dir, "documents").select(
            "doc_id", F.size(t).cast("bigint").alias("n_terms"), joined(t).alias("terms"))
    return fn


for _lang, _name in ((ENGLISH, "stopword_filter_en"), (SPANISH, "stopword_filter_es")):
    register(_name, f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT doc_id, {S.terms('text', _lang)} AS t FROM documents)""")(_stopword_query(_lang))


@register("analyze_tokens", f"""
SELECT doc_id, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos, unnest(t) AS term
FROM (SELECT doc_id, {S.terms('text')} AS t FROM documents)""")
def q_analyze_tokens(spark, sf_dir):
    return analyze(read_table(spark, sf_dir, "documents"), "text", ("doc_id",))


@register("language_dispatch", f"""
SELECT doc_id, lang, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT doc_id, lang, {S.terms_by_lang('text', 'lang')} AS t FROM documents)""")
def q_language_dispatch(spark, sf_dir):
    t = T.analyzed_terms(F.col("text"), lang_col=F.col("lang"))
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.size(t).cast("bigint").alias("n_terms"), joined(t).alias("terms"))


@register("doc_title", f"""
SELECT doc_id, title FROM ({S.CORPUS_DOCS})""")
def q_doc_title(spark, sf_dir):
    return corpus_documents(spark, sf_dir).select("doc_id", "title")


# --------------------------------------------------------------------------
# The index
# --------------------------------------------------------------------------

_TOKENS_SQL = f"""toks AS (
  SELECT doc_id, unnest(t) AS term, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos
  FROM (SELECT doc_id, {S.terms('text')} AS t FROM documents))"""

_POSTINGS_SQL = f"""WITH {_TOKENS_SQL},
postings AS (
  SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf,
         string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
  FROM toks GROUP BY term, doc_id)"""


@register("postings", _POSTINGS_SQL + "\nSELECT term, doc_id, tf, positions FROM postings")
def q_postings(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    return idx.postings.select("term", "doc_id", "tf", joined_ints("positions").alias("positions"))


@register("doc_frequency", _POSTINGS_SQL + """
SELECT term, count(*) AS df FROM postings GROUP BY term""")
def q_doc_frequency(spark, sf_dir):
    return corpus_index(spark, sf_dir).term_stats


@register("index_stats", _POSTINGS_SQL + """
SELECT (SELECT count(*) FROM documents) AS total_documents,
       (SELECT count(DISTINCT term) FROM postings) AS total_terms,
       CAST(CASE WHEN (SELECT count(*) FROM documents) > 0 THEN TIMESTAMP '2024-01-05 06:07:08' END AS VARCHAR)
         AS last_indexed_at""")
def q_index_stats(spark, sf_dir):
    stats = corpus_index(spark, sf_dir, indexed_at="2024-01-05 06:07:08").stats
    return stats.withColumn("last_indexed_at", F.col("last_indexed_at").cast("string"))


@register("idf", _POSTINGS_SQL + f""",
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round({S.idf('df', 'n')}, 6) AS idf FROM dfs CROSS JOIN n""")
def q_idf(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    n = idx.documents.agg(F.count(F.lit(1)).alias("total_documents"))
    return (idx.term_stats.crossJoin(F.broadcast(n))
            .select("term", "df", F.round(T.idf(F.col("df"), F.col("total_documents")), 6)
                    .alias("idf")))


@register("term_lookup", _POSTINGS_SQL + f"""
SELECT term, doc_id, tf, positions FROM postings WHERE term IN {S.sql_in_list(LOOKUP_TERMS)}""")
def q_term_lookup(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    return (idx.postings.filter(F.col("term").isin(list(LOOKUP_TERMS)))
            .select("term", "doc_id", "tf", joined_ints("positions").alias("positions")))


# --------------------------------------------------------------------------
# search
# --------------------------------------------------------------------------

def _scores_sql(query_terms: list[str]) -> str:
    counts: dict[str, int] = {}
    for t in query_terms:
        counts[t] = counts.get(t, 0) + 1
    values = ", ".join(f"({S.sql_str(t)}, {c})" for t, c in counts.items())
    return f"""WITH {_TOKENS_SQL},
q(term, qtf) AS (VALUES {values}),
tf AS (SELECT term, doc_id, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM q)
       GROUP BY term, doc_id),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
scores AS (SELECT doc_id, sum(tf * qtf * {S.idf('df', 'n')}) AS score
           FROM tf JOIN dfs USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY doc_id),
docs AS ({S.CORPUS_DOCS}),
ranked AS (SELECT doc_id, title, url, round(score, 6) AS score,
                  row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank
           FROM scores JOIN docs USING (doc_id))"""


def _page_sql(query: str, page: int, limit: int) -> str:
    lo, hi = (page - 1) * limit, page * limit
    return (_scores_sql(query.split()) +
            f"\nSELECT doc_id, title, url, score, CAST(rank AS INTEGER) AS rank FROM ranked "
            f"WHERE rank > {lo} AND rank <= {hi}")


@register("tfidf_scores", _scores_sql(REPEATED_QUERY_TEXT.split()) + """
SELECT doc_id, score FROM ranked""")
def q_tfidf_scores(spark, sf_dir):
    scores = score_documents(corpus_index(spark, sf_dir), REPEATED_QUERY_TEXT)
    return scores.select("doc_id", F.round("score", 6).alias("score"))


@register("search_page1", _page_sql(QUERY_TEXT, 1, 10))
def q_search_page1(spark, sf_dir):
    return search(corpus_index(spark, sf_dir), QUERY_TEXT, page=1, limit=10)


@register("search_page2", _page_sql(QUERY_TEXT, 2, 10))
def q_search_page2(spark, sf_dir):
    return search(corpus_index(spark, sf_dir), QUERY_TEXT, page=2, limit=10)


@register("search_after_page1", _page_sql(QUERY_TEXT, 2, 10))
def q_search_after(spark, sf_dir):
    """The second page, from a cursor at the end of the first."""
    index = corpus_index(spark, sf_dir)
    first = search_after(index, QUERY_TEXT, limit=10).collect()
    return search_after(index, QUERY_TEXT, cursor(first), limit=10)


@register("search_stored", _page_sql(QUERY_TEXT, 1, 10))
def q_search_stored(spark, sf_dir):
    """Search an index that was written under the checkpoint folder and read back."""
    store = IndexStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    store.write(corpus_index(spark, sf_dir))
    return search(store.read(), QUERY_TEXT, page=1, limit=10)


@register("search_envelope", _scores_sql(QUERY_TEXT.split()) + """
SELECT '{"data":[' || string_agg('{"docID":"' || doc_id || '","title":' || to_json(title)
         || ',"url":' || to_json(url) || '}', ',' ORDER BY rank) FILTER (rank <= 10)
       || '],"page":1,"limit":10,"total":' || count(*) || '}' AS response FROM ranked""")
def q_search_envelope(spark, sf_dir):
    return search_envelope(corpus_index(spark, sf_dir), QUERY_TEXT, page=1, limit=10)


@register("search_repeated_terms", _page_sql(REPEATED_QUERY_TEXT, 1, 10))
def q_search_repeated(spark, sf_dir):
    return search(corpus_index(spark, sf_dir), REPEATED_QUERY_TEXT, page=1, limit=10)


@register("search_total", _scores_sql(QUERY_TEXT.split()) + """
SELECT count(*) AS total FROM ranked""")
def q_search_total(spark, sf_dir):
    return search_total(corpus_index(spark, sf_dir), QUERY_TEXT)


_BATCH_SQL = f"""WITH {_TOKENS_SQL},
qt AS (SELECT query_id, term, count(*) AS qtf FROM (
         SELECT item_id AS query_id, unnest({S.terms('text')}) AS term FROM benchmark)
       GROUP BY query_id, term),
tf AS (SELECT term, doc_id, count(*) AS tf FROM toks
       WHERE term IN (SELECT term FROM qt) GROUP BY term, doc_id),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
scores AS (SELECT query_id, doc_id, round(sum(tf * qtf * {S.idf('df', 'n')}), 6) AS score
           FROM tf JOIN dfs USING (term) JOIN qt USING (term) CROSS JOIN n
           GROUP BY query_id, doc_id),
ranked AS (SELECT query_id, doc_id, score,
                  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
           FROM scores),
docs AS ({S.CORPUS_DOCS})
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, title, url, score
FROM ranked JOIN docs USING (doc_id) WHERE rank <= 10"""


def _batch_sql(query_source: str) -> str:
    return _BATCH_SQL.replace(
        "SELECT item_id AS query_id, unnest(" + S.terms('text') + ") AS term FROM benchmark",
        f"SELECT query_id, unnest({S.terms('text')}) AS term FROM ({query_source})")


# Every conversation turn as a query; the id is "conv_id/turn".
_CONV_QUERIES_SQL = "SELECT conv_id || '/' || turn AS query_id, text FROM conversations"


@register("batch_search_conversations", _batch_sql(_CONV_QUERIES_SQL))
def q_batch_search_conversations(spark, sf_dir):
    queries = read_table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("query_id"), "text")
    return batch_search(corpus_index(spark, sf_dir), queries, k=10)


@register("batch_search_topk", _BATCH_SQL)
def q_batch_search_topk(spark, sf_dir):
    queries = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text")
    return batch_search(corpus_index(spark, sf_dir), queries, k=10)


# --------------------------------------------------------------------------
# Web pages, links and URLs
# --------------------------------------------------------------------------

from textindex.functions import html as H  # noqa: E402
from textindex.functions import urls as U  # noqa: E402
from textindex.operators.web import page_documents, page_links  # noqa: E402


@register("html_title", f"SELECT page_id, {S.html_title('html')} AS title FROM pages")
def q_html_title(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", H.html_title("html").alias("title"))


@register("html_text", f"SELECT page_id, {S.visible_text('html')} AS text FROM pages")
def q_html_text(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", H.visible_text("html").alias("text"))


@register("html_min_length", f"""
SELECT page_id, url, CAST(octet_length(encode(t)) AS INTEGER) AS n_bytes
FROM (SELECT page_id, url, {S.visible_text('html')} AS t FROM pages)
WHERE octet_length(encode(t)) >= 100""")
def q_html_min_length(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url",
                                                      H.visible_text("html").alias("t"))
    return (pages.filter(H.has_min_content(F.col("t")))
            .select("page_id", "url", F.octet_length("t").cast("int").alias("n_bytes")))


@register("raw_word_count", f"SELECT page_id, {S.word_count('html')} AS n_words FROM pages")
def q_raw_word_count(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select(
        "page_id", T.word_count("html").cast("bigint").alias("n_words"))


@register("url_parts", f"""
SELECT page_id, {S.scheme('url')} AS scheme, {S.hostname('url')} AS host,
       {S.url_path('url')} AS path, {S.raw_query('url')} AS query,
       {S.robots_path('url')} AS robots_path FROM pages""")
def q_url_parts(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select(
        "page_id", U.scheme("url").alias("scheme"), U.hostname("url").alias("host"),
        U.path("url").alias("path"), U.raw_query("url").alias("query"),
        U.robots_path("url").alias("robots_path"))


_LINKS_SQL = f"""
SELECT page_id, url AS base, CAST(unnest(range(0, len(h))) AS INTEGER) AS link_pos, unnest(h) AS href
FROM (SELECT page_id, url, {S.hrefs('html')} AS h FROM pages)"""


@register("links_same_host", f"""
SELECT page_id, link_pos, href, link FROM (
  SELECT page_id, base, link_pos, href, {S.resolve('base', 'href')} AS link FROM ({_LINKS_SQL}))
WHERE link IS NOT NULL AND link <> '' AND {S.hostname('link')} = {S.hostname('base')}""")
def q_links_same_host(spark, sf_dir):
    return page_links(read_table(spark, sf_dir, "pages"))


# Every href is also rewritten into relative forms so that each resolution
# branch is exercised on the whole table.
_VARIANTS_SPARK = [
    ("as_is", lambda h, host: h),
    ("relative", lambda h, host: F.regexp_replace(h, "^/", "")),
    ("parent", lambda h, host: F.concat(F.lit("../x/.."), h)),
    ("dot", lambda h, host: F.concat(F.lit("./"), F.regexp_replace(h, "^/", ""))),
    ("net_path", lambda h, host: F.concat(F.lit("//"), host, h)),
    ("query", lambda h, host: F.concat(F.lit("?q="), F.regexp_replace(h, "^/", ""))),
    ("fragment", lambda h, host: F.concat(F.lit("#"), F.regexp_replace(h, "^/", ""))),
    ("non_ascii", lambda h, host: F.concat(h, F.lit("/é ü?q=é#ñ"))),
    ("escaped", lambda h, host: F.concat(F.lit("/%61/../%65"), h)),
    ("bad_escape", lambda h, host: F.concat(h, F.lit("%zz"))),
    ("bad_port", lambda h, host: F.concat(F.lit("//"), host, F.lit(":x1"), h)),
    ("colon_first", lambda h, host: F.concat(F.lit("1:"), h)),
]
_VARIANTS_SQL = [
    ("as_is", "href"),
    ("relative", "regexp_replace(href, '^/', '')"),
    ("parent", "'../x/..' || href"),
    ("dot", "'./' || regexp_replace(href, '^/', '')"),
    ("net_path", f"'//' || {S.hostname('base')} || href"),
    ("query", "'?q=' || regexp_replace(href, '^/', '')"),
    ("fragment", "'#' || regexp_replace(href, '^/', '')"),
    ("non_ascii", "href || '/é ü?q=é#ñ'"),
    ("escaped", "'/%61/../%65' || href"),
    ("bad_escape", "href || '%zz'"),
    ("bad_port", f"'//' || {S.hostname('base')} || ':x1' || href"),
    ("colon_first", "'1:' || href"),
]


@register("resolve_url", f"""
SELECT page_id, link_pos, variant, ref, {S.resolve('base', 'ref')} AS link FROM (
  SELECT page_id, base, link_pos, v.variant, v.ref FROM ({_LINKS_SQL}) l,
  LATERAL (VALUES {", ".join(f"('{n}', {e})" for n, e in _VARIANTS_SQL)}) v(variant, ref))""")
def q_resolve_url(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.col("url").alias("base"),
                         F.posexplode(H.hrefs("html")).alias("link_pos", "href"))
    variants = F.array(*[F.struct(F.lit(n).alias("variant"),
                                  fn(F.col("href"), U.hostname(F.col("base"))).alias("ref"))
                         for n, fn in _VARIANTS_SPARK])
    v = links.select("page_id", "base", "link_pos", F.explode(variants).alias("v"))
    return v.select("page_id", "link_pos", "v.variant", "v.ref",
                    U.resolve(F.col("base"), F.col("v.ref")).alias("link"))


_WEB_DOCS_SQL = f"""web AS (
  SELECT doc_id, source_type, url, title, content FROM (
    SELECT page_id AS doc_id, 'web' AS source_type, url, {S.html_title('html')} AS title,
           {S.visible_text('html')} AS content,
           row_number() OVER (PARTITION BY url ORDER BY
             octet_length(encode({S.visible_text('html')})) >= 100 DESC, page_id DESC) AS rn
    FROM pages)
  WHERE rn = 1 AND octet_length(encode(content)) >= 100)"""


@register("web_postings", f"""WITH {_WEB_DOCS_SQL},
toks AS (SELECT doc_id, unnest(t) AS term, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos
         FROM (SELECT doc_id, {S.terms('content')} AS t FROM web))
SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf,
       string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM toks GROUP BY term, doc_id""")
def q_web_postings(spark, sf_dir):
    docs = page_documents(read_table(spark, sf_dir, "pages"))
    idx = build_index(docs, text_col="content")
    return idx.postings.select("term", "doc_id", "tf", joined_ints("positions").alias("positions"))


# Ids are unique across sources: "file:<doc_id>" and "web:<page_id>".
_UNION_SQL = f"""WITH {_WEB_DOCS_SQL}, files AS ({S.CORPUS_DOCS}),
both_sources AS (
  SELECT source_type || ':' || doc_id AS doc_id, source_type, url, title, content FROM files
  UNION ALL SELECT source_type || ':' || doc_id, source_type, url, title, content FROM web)"""


def _union(spark, sf_dir):
    files = corpus_documents(spark, sf_dir).select("source_type", "doc_id", "url", "title", "content")
    web = page_documents(read_table(spark, sf_dir, "pages")).select(*files.columns)
    return files.unionByName(web).withColumn(
        "doc_id", F.concat_ws(":", "source_type", F.col("doc_id").cast("string")))


@register("union_sources", _UNION_SQL + """
SELECT source_type, doc_id, url, title, CAST(octet_length(encode(content)) AS INTEGER) AS n_bytes
FROM both_sources""")
def q_union_sources(spark, sf_dir):
    return _union(spark, sf_dir).select("source_type", "doc_id", "url", "title",
                                        F.octet_length("content").cast("int").alias("n_bytes"))


@register("union_postings", _UNION_SQL + f""",
toks AS (SELECT doc_id, unnest(t) AS term, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos
         FROM (SELECT doc_id, {S.terms('content')} AS t FROM both_sources))
SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf,
       string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM toks GROUP BY term, doc_id""")
def q_union_postings(spark, sf_dir):
    idx = build_index(_union(spark, sf_dir), text_col="content")
    return idx.postings.select("term", "doc_id", "tf", joined_ints("positions").alias("positions"))


# Every page is also rewritten: links single-quoted or bare, no body tag, a body end
# inside a script, references named, numeric and without semicolons, ">" in attributes,
# titles in comments and scripts, markup in raw-text elements.
_HTML_FORMS = [
    ("single_quoted", "replace(html, '\"', '\\'')", "replace(html, '\"', chr(39))"),
    ("bare", """regexp_replace(html, 'href="([^" ]*)"', 'href=$1')""",
     r"""regexp_replace(html, 'href="([^" ]*)"', 'href=\1', 'g')"""),
    ("no_body", "regexp_replace(html, '</?body>', '')", "regexp_replace(html, '</?body>', '', 'g')"),
    ("script", "replace(html, '<body>', '<body><script>var s=\"</body>\";</script>')",
     "replace(html, '<body>', '<body><script>var s=\"</body>\";</script>')"),
    ("references", "replace(html, '<p>', '<p>caf&eacute; &#233;&#xE9; &amp;lt; &hellip; ')",
     "replace(html, '<p>', '<p>caf&eacute; &#233;&#xE9; &amp;lt; &hellip; ')"),
    *[(name, *[f"replace(html, '{old}', '{new}')"] * 2) for name, old, new in (
    ("no_semicolon", "<p>", '<p>&copy 2020 caf&eacute &#233 &#xE9x&amp&ltb <a href="/q?a=1&copy=2&amp;b=3&lt">l</a> '),
    ("quoted_gt", "<p>", '<p title="a>b" data-x=c>x<a title="a>b" class=k href="/z>q">z</a><img alt="<a href=/no>"> '),
    ("hidden_title", "<title>", '<!-- <title>old</title> --><script>var t="<title>js</title>";</script><title lang="a>b">'),
    ("raw_text", "<p>", '<p><textarea rows=2><a href="/in">t&amp;</a></textarea><iframe><a href="/f">f</a></iframe> '),
    ("upper", "<p>", '<P CLASS="x"><SCRIPT TYPE="a>b">no()</SCRIPT><A HREF=/up>up</A><B>old</B> '))],
]


@register("html_variants", f"""
SELECT page_id, form, {S.html_title('html')} AS title, {S.visible_text('html')} AS text, array_to_string({S.hrefs('html')}, ' ') AS links FROM (
  {" UNION ALL ".join(f"SELECT page_id, '{n}' AS form, {q} AS html FROM pages" for n, _, q in _HTML_FORMS)})""")
def q_html_variants(spark, sf_dir):
    forms = F.array(*[F.struct(F.lit(n).alias("form"), F.expr(e).alias("html")) for n, e, _ in _HTML_FORMS])
    pages = (read_table(spark, sf_dir, "pages").select("page_id", F.explode(forms).alias("f"))
             .select("page_id", "f.form", "f.html"))
    return pages.select("page_id", "form", H.html_title("html").alias("title"),
                        H.visible_text("html").alias("text"), joined(H.hrefs("html")).alias("links"))


# --------------------------------------------------------------------------
# Robots and crawl
# --------------------------------------------------------------------------

from textindex.operators.crawl import crawl, crawl_schedule, crawl_summary  # noqa: E402
from textindex.operators.ranking import row_number_within  # noqa: E402
from textindex.operators.robots import host_rules, robots_decision, robots_rules  # noqa: E402
from textindex.plans import sql_crawl as SC  # noqa: E402
from textindex.sources.robots import derived_robots  # noqa: E402

CRAWL_MAX_DEPTH = 3


def _hosts(spark, sf_dir):
    return host_rules(derived_robots(read_table(spark, sf_dir, "pages")))


@register("robots_rules", "WITH " + SC.robots_ctes() + """
SELECT host, grp, kind, pattern, line_no FROM applied_rules""")
def q_robots_rules(spark, sf_dir):
    return robots_rules(_hosts(spark, sf_dir))


@register("robots_delays", "WITH " + SC.robots_ctes() + """
SELECT host, grp, crawl_delay FROM applied_delays""")
def q_robots_delays(spark, sf_dir):
    return _hosts(spark, sf_dir).select("host", "grp", "crawl_delay")


# Every URL is decided as it is and with its path's first letter percent-encoded,
# which must not change the decision.
def _targets(pages):
    escaped = F.regexp_replace("url", "^(https?://[^/]*)/e", "$1/%65")
    forms = F.array(F.struct(F.lit("plain").alias("form"), F.col("url").alias("url")),
                    F.struct(F.lit("escaped").alias("form"), escaped.alias("url")))
    return (pages.select("page_id", F.explode(forms).alias("f"))
            .select("page_id", "f.form", "f.url"))


_TARGETS_SQL = r"""(SELECT page_id, 'plain' AS form, url FROM pages UNION ALL
  SELECT page_id, 'escaped', regexp_replace(url, '^(https?://[^/]*)/e', '\1/%65') FROM pages)"""


def _decision_query(mode):
    def fn(spark, sf_dir):
        pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
        return (robots_decision(_targets(pages), _hosts(spark, sf_dir), mode=mode)
                .select("page_id", "form", "url", "host", "robots_path", "allowed", "crawl_delay"))
    return fn


for _mode, _name in (("reference", "robots_decision"), ("longest", "robots_decision_longest")):
    register(_name, "WITH " + SC.robots_ctes() + f"""
SELECT page_id, form, url, host, robots_path, allowed, crawl_delay
FROM {SC.decision_sql(_TARGETS_SQL, "url", _mode)}""")(_decision_query(_mode))


# The pages of a host, in order of URL, are made a binary tree: page n gets links to
# pages 2n and 2n + 1, as paths, and the crawl starts at page 1 of each host.
def _linked_pages(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    pages = read_table(spark, sf_dir, "pages")
    urls = pages.select(U.hostname("url").alias("host"), "url").distinct()
    n = row_number_within(urls, "host", ["url"], out="n").checkpoint(eager=True)
    child = n.select(F.col("host").alias("host"), F.floor(F.col("n") / 2).alias("n"),
                     F.regexp_replace("url", "^https?://[^/]*", "").alias("path"))
    links = (n.join(child, ["host", "n"]).groupBy("url")
             .agg(F.array_join(F.array_sort(F.collect_list(F.concat(
                 F.lit("<a href='"), "path", F.lit("'>more</a>")))), "").alias("links")))
    linked = pages.join(links, "url", "left").select(
        "page_id", "url", F.concat("html", F.coalesce("links", F.lit(""))).alias("html"))
    return n.filter("n = 1").select("url"), linked


def _crawl(spark, sf_dir):
    seeds, pages = _linked_pages(spark, sf_dir)
    robots = derived_robots(read_table(spark, sf_dir, "pages"))
    return crawl(seeds, pages, robots, max_depth=CRAWL_MAX_DEPTH)


_CRAWL_SQL = SC.crawl_ctes(CRAWL_MAX_DEPTH)


@register("crawl_frontier", _CRAWL_SQL + "\nSELECT url, depth FROM report")
def q_crawl_frontier(spark, sf_dir):
    return _crawl(spark, sf_dir).frontier.select("url", F.col("depth").cast("int").alias("depth"))


@register("crawl_report", _CRAWL_SQL + """
SELECT url, depth, allowed, found, status_code, title, status FROM report""")
def q_crawl_report(spark, sf_dir):
    r = _crawl(spark, sf_dir).report
    return r.select("url", F.col("depth").cast("int").alias("depth"), "allowed", "found",
                    "status_code", "title", "status")


@register("crawl_summary", _CRAWL_SQL + """
SELECT status, count(*) AS n_pages FROM report GROUP BY status""")
def q_crawl_summary(spark, sf_dir):
    return crawl_summary(_crawl(spark, sf_dir).report)


@register("crawl_schedule", _CRAWL_SQL + """
SELECT host, url, depth, slot, (slot - 1) * crawl_delay AS fetch_offset_s FROM (
  SELECT host, url, depth, crawl_delay,
         row_number() OVER (PARTITION BY host ORDER BY depth, url) AS slot
  FROM report WHERE allowed)""")
def q_crawl_schedule(spark, sf_dir):
    s = crawl_schedule(_crawl(spark, sf_dir).report)
    return s.select("host", "url", F.col("depth").cast("int").alias("depth"), "slot",
                    "fetch_offset_s")


# --------------------------------------------------------------------------
# Incremental re-index
# --------------------------------------------------------------------------

from textindex.plans.store import IndexStore, changed_ids, reindex  # noqa: E402

# The stored index holds the English documents as of 2024-01-04, in an older
# wording (vowels rotated); the incoming scan holds every document with a
# modification time derived from its length, and is the whole table.
STORED_AT = "2024-01-04 00:00:00"
OLD_WORDING = ("aeiou", "uoiea")


def _incoming(spark, sf_dir):
    docs = corpus_documents(spark, sf_dir)
    mtime = F.date_add(F.lit("2024-01-01").cast("date"),
                       F.pmod(F.length("content"), F.lit(7)).cast("int")).cast("timestamp")
    return docs.withColumn("modified_at", mtime)


def _stored_index(spark, sf_dir):
    old = (corpus_documents(spark, sf_dir).filter(F.col("lang") == "en")
           .withColumn("content", F.translate("content", *OLD_WORDING))
           .withColumn("modified_at", F.lit(STORED_AT).cast("timestamp")))
    return build_index(old, text_col="content")


_INCOMING_SQL = f"""incoming AS (
  SELECT *, CAST(DATE '2024-01-01' + CAST(length(content) % 7 AS INTEGER) AS TIMESTAMP) AS modified_at
  FROM ({S.CORPUS_DOCS}))"""


@register("changed_docs", f"""WITH {_INCOMING_SQL}
SELECT i.file_path, i.doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' ELSE 'modified' END AS change
FROM incoming i LEFT JOIN (SELECT doc_id, file_path FROM ({S.CORPUS_DOCS}) WHERE lang = 'en') s
  ON i.file_path = s.file_path
WHERE s.doc_id IS NULL OR i.modified_at > TIMESTAMP '{STORED_AT}'""")
def q_changed_docs(spark, sf_dir):
    stored = _stored_index(spark, sf_dir).documents
    return changed_ids(_incoming(spark, sf_dir), stored).select("file_path", "doc_id", "change")


_REINDEXED_SQL = f"""WITH {_INCOMING_SQL},
final_docs AS (
  SELECT doc_id, CASE WHEN lang = 'en' AND modified_at <= TIMESTAMP '{STORED_AT}'
                      THEN translate(content, '{OLD_WORDING[0]}', '{OLD_WORDING[1]}')
                      ELSE content END AS content
  FROM incoming),
toks AS (SELECT doc_id, unnest(t) AS term, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos
         FROM (SELECT doc_id, {S.terms('content')} AS t FROM final_docs))
SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf,
       string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM toks GROUP BY term, doc_id"""


@register("delete_reindex", _REINDEXED_SQL)
def q_delete_reindex(spark, sf_dir):
    idx = reindex(_stored_index(spark, sf_dir), _incoming(spark, sf_dir))
    return idx.postings.select("term", "doc_id", "tf", joined_ints("positions").alias("positions"))


@register("update_stored", _REINDEXED_SQL)
def q_update_stored(spark, sf_dir):
    """The same change through a stored index: only changed documents are analyzed again."""
    store = IndexStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    store.write(_stored_index(spark, sf_dir))
    store.update(_incoming(spark, sf_dir))
    return store.read().postings.select("term", "doc_id", "tf", joined_ints("positions").alias("positions"))


@register("stored_stats", f"""WITH {_INCOMING_SQL},
toks AS (SELECT doc_id, unnest({S.terms(f"""CASE WHEN lang = 'en' AND modified_at <= TIMESTAMP '{STORED_AT}'
  THEN translate(content, '{OLD_WORDING[0]}', '{OLD_WORDING[1]}') ELSE content END""")}) AS term FROM incoming)
SELECT term, count(DISTINCT doc_id) AS df, (SELECT count(*) FROM incoming) AS total_documents,
       (SELECT count(DISTINCT term) FROM toks) AS total_terms
FROM toks GROUP BY term""")
def q_stored_stats(spark, sf_dir):
    """Statistics of a stored and updated index, merged from its buckets' counts."""
    store = IndexStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}", buckets=8)
    store.write(_stored_index(spark, sf_dir))
    store.update(_incoming(spark, sf_dir))
    index = store.read()
    return index.term_stats.crossJoin(F.broadcast(index.stats.select("total_documents", "total_terms")))


# --------------------------------------------------------------------------
# C4, G3 stemmed
# --------------------------------------------------------------------------

from textindex.operators.stemming import StemDictionary, stem_vocabulary  # noqa: E402

STEMMED_QUERY_TEXT = "threes ing bles running"

_STEM_TOKENS_SQL = f"""raw AS (
  SELECT doc_id, CASE WHEN lower(trim(lang)) IN ('spanish', 'es') THEN 'spanish' ELSE 'english' END AS language,
         unnest(t) AS term, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos
  FROM (SELECT doc_id, lang, {S.terms_by_lang('text', 'lang')} AS t FROM documents)),
{S.stem_ctes('raw')}"""


@register("stem_vocabulary", f"WITH {_STEM_TOKENS_SQL}\nSELECT language, term, stem FROM st_stems")
def q_stem_vocabulary(spark, sf_dir):
    terms = analyze(corpus_documents(spark, sf_dir).withColumn(
        "language", language_column(F.col("lang"))), "content", ("doc_id", "language"),
        lang_col="lang")
    return stem_vocabulary(terms)


@register("analyze_stemmed", f"""WITH {_STEM_TOKENS_SQL}
SELECT doc_id, pos, stem AS term FROM raw JOIN st_stems USING (language, term)""")
def q_analyze_stemmed(spark, sf_dir):
    return analyze(read_table(spark, sf_dir, "documents"), "text", ("doc_id",),
                   lang_col="lang", stem=True)


@register("analyze_stemmed_stored", f"""WITH {_STEM_TOKENS_SQL}
SELECT doc_id, pos, stem AS term FROM raw JOIN st_stems USING (language, term)""")
def q_analyze_stemmed_stored(spark, sf_dir):
    """Stems from a kept dictionary that a run over the English documents began."""
    kept = StemDictionary(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/stems-{uuid.uuid4().hex}")
    docs = read_table(spark, sf_dir, "documents")
    english = analyze(docs.filter("lang = 'en'").withColumn("language", F.lit(ENGLISH)), "text", ("doc_id", "language"))
    kept.stems(english.select("language", "term").distinct())
    return analyze(docs, "text", ("doc_id",), lang_col="lang", stem=True, dictionary=kept)


@register("search_stemmed", f"""WITH plain AS (
  SELECT doc_id, 'english' AS language, unnest({S.terms('text')}) AS term FROM documents
  UNION ALL SELECT NULL, 'english', unnest({S.terms(S.sql_str(STEMMED_QUERY_TEXT))})),
{S.stem_ctes('plain')},
toks AS (SELECT doc_id, stem AS term FROM plain JOIN st_stems USING (language, term)),
q AS (SELECT term, count(*) AS qtf FROM toks WHERE doc_id IS NULL GROUP BY term),
tf AS (SELECT term, doc_id, count(*) AS tf FROM toks WHERE doc_id IS NOT NULL GROUP BY term, doc_id),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
scores AS (SELECT doc_id, round(sum(tf * qtf * {S.idf('df', 'n')}), 6) AS score
           FROM tf JOIN dfs USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY doc_id),
docs AS ({S.CORPUS_DOCS})
SELECT doc_id, title, url, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM scores JOIN docs USING (doc_id) QUALIFY rank <= 10""")
def q_search_stemmed(spark, sf_dir):
    return search(corpus_index(spark, sf_dir, stem=True), STEMMED_QUERY_TEXT, page=1,
                  limit=10, stem=True)
