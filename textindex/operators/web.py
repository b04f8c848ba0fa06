"""Web pages to documents and links.

A page snapshot table ``(page_id, url, html)`` stands in for fetched pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textindex.functions import html as H
from textindex.functions import urls as U

MIN_CONTENT_BYTES = 100


def page_documents(pages: DataFrame, id_col: str = "page_id",
                   min_bytes: int = MIN_CONTENT_BYTES, modified_at=None) -> DataFrame:
    """C8 + C9 + C10 + C16: one web document per page with enough visible text.

    ``(doc_id, source_type='web', url, title, content)``. One document per URL,
    the row with the highest id wins (V7); the dedup window partitions by URL,
    which holds one row per copy of a page, not per term or host. A copy that is too
    short does not replace a longer one. ``modified_at`` (a timestamp or its text)
    adds the time of the snapshot.
    """
    docs = pages.select(
        F.col(id_col).alias("doc_id"),
        F.lit("web").alias("source_type"),
        F.col("url"),
        H.html_title(F.col("html")).alias("title"),
        H.visible_text(F.col("html")).alias("content"))
    # Filtering directly on ``content`` would be pushed below the projection
    # with the regex chain inlined, evaluating it twice. Instead the window
    # ranks long-enough pages first and the filter stays above it.
    docs = docs.withColumn("_long", H.has_min_content(F.col("content"), min_bytes))
    latest = Window.partitionBy("url").orderBy(F.col("_long").desc(), F.col("doc_id").desc())
    docs = (docs.withColumn("_n", F.row_number().over(latest))
            .filter((F.col("_n") == 1) & F.col("_long")).drop("_n", "_long"))
    if modified_at is None:
        return docs
    return docs.withColumn("modified_at", F.lit(modified_at).cast("timestamp"))


def same_host_links(base, html) -> F.Column:
    """C11 + C12 + D4 as one array expression: resolved same-host links of a page."""
    base = F.col(base) if isinstance(base, str) else base
    html = F.col(html) if isinstance(html, str) else html
    resolved = F.transform(H.hrefs(html), lambda h: U.resolve(base, h))
    return F.filter(resolved, lambda l: l.isNotNull() & (l != F.lit("")) & U.is_valid(l)
                    & (U.hostname(l) == U.hostname(base)))


def page_links(pages: DataFrame, id_col: str = "page_id", same_host: bool = True) -> DataFrame:
    """C11 + C12 + D4: ``(page_id, link_pos, href, link)`` for every resolvable href.

    Links whose hostname differs from the page's (ports ignored, case-sensitive)
    are dropped when ``same_host``; hrefs that do not resolve or parse are dropped.
    """
    links = pages.select(F.col(id_col).alias("page_id"), F.col("url").alias("base"),
                         F.posexplode(H.hrefs(F.col("html"))).alias("link_pos", "href"))
    links = links.withColumn("link", U.resolve(F.col("base"), F.col("href")))
    links = links.filter(F.col("link").isNotNull() & (F.col("link") != F.lit(""))
                         & U.is_valid(F.col("link")))
    if same_host:
        links = links.filter(U.hostname(F.col("link")) == U.hostname(F.col("base")))
    return links.select("page_id", "link_pos", "href", "link")
