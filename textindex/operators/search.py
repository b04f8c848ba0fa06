"""TF-IDF search over an index.

score(doc) = sum over the query's terms (with repetition) of tf * ln(1 + N/df).
Scoring only ever touches tokens or postings of the queries' terms: the filter on
``term`` comes before the aggregation, or reaches the parquet scan of a stored index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textindex.functions.stopwords import ENGLISH
from textindex.functions.text import idf
from textindex.operators.analyze import analyze, query_term_counts
from textindex.operators.index import Index
from textindex.operators.tiles import document_counts, pack_documents, packed_scores
from textindex.session import ensure_checkpoint_dir

SCORE_DIGITS = 6
BROADCAST_BYTES = 16 << 20
VOCABULARY_BYTES = 64 << 20
BLOCK_DOCS = 256            # documents bounded together in a tile of a batch search
FIRST_BLOCKS = 2            # as many of the longest documents as in so many blocks give a query its threshold
DOCS_PER_TASK = 4000        # documents whose matched tokens a task of a batch search counts
RESULT_COLUMNS = ("doc_id", "title", "url", "score")


def validate_paging(page, limit) -> tuple[int, int]:
    """C17: ``page`` and ``limit`` are required integers >= 1."""
    try:
        page_i, limit_i = int(page), int(limit)
    except (TypeError, ValueError) as exc:
        raise ValueError(f"page and limit must be integers, got {page!r}, {limit!r}") from exc
    if str(page_i) != str(page).strip() or str(limit_i) != str(limit).strip():
        raise ValueError(f"page and limit must be integers, got {page!r}, {limit!r}")
    if page_i < 1 or limit_i < 1:
        raise ValueError("page and limit must be >= 1")
    return page_i, limit_i


def _total_documents(index: Index, total_documents: int | None) -> DataFrame:
    total_documents = index.total_documents if total_documents is None else total_documents
    if total_documents is not None:
        return index.stats.sparkSession.range(1).select(
            F.lit(int(total_documents)).cast("long").alias("total_documents"))
    # Counted from the documents alone: ``stats`` also carries the distinct-term
    # count, which would drag a full postings aggregation into the plan.
    return index.documents.agg(F.count(F.lit(1)).alias("total_documents"))


def term_weights(df_by_term: DataFrame, qtf: dict[str, int], n: DataFrame) -> DataFrame:
    """E2 + E7 + C15: ``(term, weight = qtf * idf)`` for the query's terms.

    At most one row per distinct query term, so it is safe to broadcast.
    """
    terms = sorted(qtf)
    qtf_map = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(int(qtf[t])))])
    return (df_by_term.crossJoin(F.broadcast(n))
            .select("term", (idf(F.col("df"), F.col("total_documents"))
                             * F.element_at(qtf_map, F.col("term"))).alias("weight")))


def _matches(index: Index, keep, terms: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """``(term, doc_id, tf)`` of the postings that ``keep`` selects, written once.

    A stored index looks up ``terms`` where they lie, if they are known by name.

    ``keep`` is applied to single tokens, before any aggregation, so only tokens
    of query terms are shuffled (by ``doc_id``, which spreads a frequent term) and
    counted. The result goes to the checkpoint folder: frequencies and scores both
    read it, and the corpus is tokenized once. ``tasks`` deals the documents out over
    as many tasks, for matches that grow with the documents.
    """
    ensure_checkpoint_dir(index.postings.sparkSession)
    by_id = ["doc_id"] if tasks is None else [tasks, "doc_id"]
    if terms is not None and index.postings_of is not None:
        found = index.postings_of(terms).select("term", "doc_id", "tf").repartition(*by_id)
    elif index.tokens is None:
        found = keep(index.postings).select("term", "doc_id", "tf").repartition(*by_id)
    else:
        found = (keep(index.tokens).select("term", "doc_id").repartition(*by_id)
                 .groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf")))
    return found.checkpoint(eager=True)


def score_documents(index: Index, query: str, language: str | None = ENGLISH,
                    stopword_list=None, stem: bool = False,
                    total_documents: int | None = None) -> DataFrame:
    """E1 + F5: ``(doc_id, score)`` for every document containing a query term."""
    spark = index.postings.sparkSession
    qtf = query_term_counts(spark, query, language, stopword_list, stem)
    if not qtf:
        kind = index.documents.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, score double")
    matches = _matches(index, lambda rows: rows.filter(F.col("term").isin(sorted(qtf))), sorted(qtf))
    df_by_term = matches.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = term_weights(df_by_term, qtf, _total_documents(index, total_documents))
    return (matches.join(F.broadcast(weights), "term")
            .groupBy("doc_id")
            .agg(F.sum(F.col("tf") * F.col("weight")).alias("score")))


def scored_documents(index: Index, query: str, **kwargs) -> DataFrame:
    """``(doc_id, score)`` of matching documents that exist."""
    scores = score_documents(index, query, **kwargs)
    return (scores.join(index.documents.select("doc_id"), "doc_id", "left_semi")
            .select("doc_id", F.round("score", SCORE_DIGITS).alias("score")))


def _with_documents(index: Index, top: DataFrame) -> DataFrame:
    """``top`` with title and url. The semi-join goes below the projection that
    derives titles, so only the documents of ``top`` get one."""
    docs = (index.documents.join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi")
            .select("doc_id", "title", "url"))
    return top.join(docs, "doc_id")


def rank_order():
    return [F.col("score").desc(), F.col("doc_id").asc()]


def search(index: Index, query: str, page=1, limit=10, **kwargs) -> DataFrame:
    """G3 + H1 + H2: one page of results, globally ordered by score then doc_id.

    ``orderBy().offset().limit()`` plans as TakeOrderedAndProject: each task
    keeps its best ``page*limit`` rows, so no full sort or single-task shuffle.
    """
    page, limit = validate_paging(page, limit)
    offset = (page - 1) * limit
    ordered = scored_documents(index, query, **kwargs).orderBy(*rank_order())
    top = ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
    # The page is at most ``limit`` rows in one partition; numbering it is free.
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())) + offset)
    return (_with_documents(index, top).select("doc_id", "title", "url", "score", "rank")
            .orderBy("rank"))


def search_after(index: Index, query: str, after: tuple | None = None, limit=10, **kwargs) -> DataFrame:
    """G3 + H2 by cursor: the ``limit`` results that follow ``after``, a ``cursor`` of the
    page before (None: the first page).

    Whatever the page's depth, a task keeps ``limit`` rows: what lies before the cursor
    is filtered out by its score and id.
    """
    _, limit = validate_paging(1, limit)
    scores, before = scored_documents(index, query, **kwargs), 0
    if after is not None:
        score, doc_id, before = after
        scores = scores.filter((F.col("score") < F.lit(score))
                               | ((F.col("score") == F.lit(score)) & (F.col("doc_id") > F.lit(doc_id))))
    top = scores.orderBy(*rank_order()).limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())) + before)
    return (_with_documents(index, top).select("doc_id", "title", "url", "score", "rank")
            .orderBy("rank"))


def cursor(page) -> tuple | None:
    """Where the next page begins, from the rows of one (at most its limit); None after the last."""
    last = max(page, key=lambda row: row["rank"], default=None)
    return None if last is None else (last["score"], last["doc_id"], last["rank"])


def search_total(index: Index, query: str, **kwargs) -> DataFrame:
    """number of matching documents that exist, one row ``(total)``."""
    return scored_documents(index, query, **kwargs).agg(F.count(F.lit(1)).alias("total"))


def search_envelope(index: Index, query: str, page=1, limit=10, **kwargs) -> DataFrame:
    """The JSON response ``{data:[{docID,title,url}], page, limit, total}``.

    ``data`` is omitted when empty; the score is not serialized. Only the page
    (at most ``limit`` rows) is collected into the array.
    """
    page_i, limit_i = validate_paging(page, limit)
    rows = search(index, query, page_i, limit_i, **kwargs)
    data = rows.agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank"), F.col("doc_id").cast("string").alias("docID"),
        F.col("title"), F.col("url")))).alias("data"))
    data = data.select(F.transform("data", lambda r: F.struct(
        r["docID"].alias("docID"), r["title"].alias("title"), r["url"].alias("url"))).alias("data"))
    total = search_total(index, query, **kwargs)
    body = F.struct(
        F.when(F.size("data") > 0, F.col("data")).alias("data"),
        F.lit(page_i).alias("page"), F.lit(limit_i).alias("limit"),
        F.col("total").cast("int").alias("total"))
    return data.crossJoin(F.broadcast(total)).select(F.to_json(body).alias("response"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text",
                language: str | None = ENGLISH, stopword_list=None, stem: bool = False,
                lang_col: str | None = None) -> DataFrame:
    """``(query_id, term, qtf)`` for a table of queries (H3 query side of F5)."""
    terms = analyze(queries, text_col=text_col, id_cols=(id_col,), language=language,
                    stopword_list=stopword_list, lang_col=lang_col, stem=stem)
    return (terms.groupBy(F.col(id_col).alias("query_id"), "term")
            .agg(F.count(F.lit(1)).alias("qtf")))


def _small(df: DataFrame, text_col: str, bound: int | None = None) -> bool:
    """Whether ``df``, counted, is small enough to broadcast."""
    size = df.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("b")).first()
    return size["b"] + 64 * size["n"] <= (BROADCAST_BYTES if bound is None else bound)


def _written(df: DataFrame) -> DataFrame:
    """``df`` from a compressed table in the checkpoint folder, for rows that a checkpoint would hold several times as large."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/search-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_scores(index: Index, queries: DataFrame, total_documents: int | None = None,
                 salts: int = 16, **kwargs) -> DataFrame:
    """``(query_id, doc_id, score)`` for a whole table of queries.

    Tokens are filtered to the queries' terms before anything is aggregated. The
    query side is broadcast when its counted size allows; the matched postings then
    stay where they are, dealt by ``doc_id``, and so do the scores. Beyond that
    size both joins shuffle, with a frequent term's postings split by document
    into ``salts`` parts and the small weight rows repeated for each.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    qt = query_terms(queries, **kwargs).checkpoint(eager=True)
    needed = qt.select("term").distinct()
    small = _small(qt, "term")
    side = F.broadcast(needed) if small else needed
    matches = _matches(index, lambda rows: rows.join(side, "term", "left_semi"))
    weights = _query_weights(matches, qt, _total_documents(index, total_documents))
    if small:
        joined = matches.join(F.broadcast(weights), "term")
    else:
        parts = weights.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        joined = (matches.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
                  .join(parts, ["term", "salt"]))
    return (joined.groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("tf") * F.col("weight")).alias("score")))


def _query_weights(matches: DataFrame, qt: DataFrame, n: DataFrame) -> DataFrame:
    """``(query_id, term, weight)``: what one occurrence of a term is worth to a query."""
    dfs = matches.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (qt.join(dfs, "term").crossJoin(F.broadcast(n))
            .select("query_id", "term",
                    (F.col("qtf") * idf(F.col("df"), F.col("total_documents"))).alias("weight")))


def numbered(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``(column, out)``: a number from 0 for each distinct value of a column, in their order."""
    found = (rows.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
             .select(column, F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at"))
             .checkpoint(eager=True))
    held = {r["_task"]: (r["first"], r["n"]) for r in found.groupBy("_task").agg(
        F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for task in range(max(held, default=0) + 1):
        first, n = held.get(task, (0, 0))
        offsets.append(F.lit(before - first))
        before += n
    return found.select(column, (F.col("_at") + F.array(*offsets)[F.col("_task")]).alias(out))


def batch_top_scores(index: Index, queries: DataFrame, k: int = 10, total_documents: int | None = None,
                     block_docs: int = BLOCK_DOCS, first_blocks: int = FIRST_BLOCKS, **kwargs) -> DataFrame:
    """``(query_id, doc_id, score)`` of every query's top ``k`` documents.

    The queries' terms are numbered; the documents' matched tokens are counted where they
    lie, dealt by ``doc_id`` as packed pieces and written once, in tiles. Every tile is
    multiplied with the queries, some broadcast at a time (``tiles``), and returns the
    documents that can be among a query's ``k`` best. Bounds leave out most blocks of
    ``block_docs`` documents, against the scores that the longest ``first_blocks`` times
    as many reach. The number of tasks follows the documents, so what one task holds does
    not grow with them.
    """
    qt = _written(query_terms(queries, **kwargs))
    terms = numbered(qt, "term", "t")
    side = F.broadcast(terms) if _small(terms, "term", VOCABULARY_BYTES) else terms
    documents = index.documents.count() if index.total_documents is None else index.total_documents
    tasks = max(qt.sparkSession.sparkContext.defaultParallelism, -(-documents // DOCS_PER_TASK))
    held = (index.postings.select("term", "doc_id", "tf") if index.tokens is None
            else index.tokens.select("term", "doc_id", F.lit(1).alias("tf")))
    tiles = pack_documents(held.join(side, "term").select(F.col("doc_id").alias("d"), "t", "tf"), tasks)
    n = _total_documents(index, documents if total_documents is None else total_documents)
    # as many rows as terms, so broadcast by the same bound
    worth = _written(terms.join(document_counts(tiles), "t").crossJoin(F.broadcast(n))
                     .select("term", "t", idf(F.col("df"), F.col("total_documents")).alias("idf")))
    side = F.broadcast(worth) if _small(worth, "term", VOCABULARY_BYTES) else worth
    asked = qt.join(side, "term").select(F.col("query_id").alias("q"), "t", (F.col("qtf") * F.col("idf")).alias("weight"))
    scores = packed_scores(tiles, index.documents.schema["doc_id"].dataType, asked, k, SCORE_DIGITS, block_docs,
                           first_blocks).select(F.col("q").alias("query_id"), F.col("d").alias("doc_id"),
                                                F.round("score", SCORE_DIGITS).alias("score"))
    ranks = Window.partitionBy("query_id").orderBy(*rank_order())
    return scores.withColumn("_rank", F.row_number().over(ranks)).filter(F.col("_rank") <= k).drop("_rank")


def batch_search(index: Index, queries: DataFrame, k: int = 10,
                 total_documents: int | None = None, **kwargs) -> DataFrame:
    """H3: top ``k`` documents per query, ``(query_id, rank, doc_id, title, url, score)``.

    Only documents that may be among them are returned by the tiles (``batch_top_scores``).
    ``row_number() <= k`` plans as a WindowGroupLimit that keeps k rows per query
    in each task before the shuffle. Titles are derived for the winners alone, whose
    ids are broadcast if their counted size allows, so whole texts stay where they lie.
    """
    scores = batch_top_scores(index, queries, k=k, total_documents=total_documents, **kwargs)
    w = Window.partitionBy("query_id").orderBy(*rank_order())
    top = (scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
           .checkpoint(eager=True))
    ids = top.select("doc_id").distinct()
    docs = (index.documents.join(F.broadcast(ids) if _small(ids, "doc_id") else ids, "doc_id", "left_semi")
            .select("doc_id", "title", "url"))
    return top.join(docs, "doc_id").select("query_id", "rank", "doc_id", "title", "url", "score")
