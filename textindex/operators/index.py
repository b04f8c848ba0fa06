"""The positional inverted index as long-form tables.

An index is four DataFrames:

* ``documents(doc_id, source_type, url, title, content, ...)``
* ``postings(term, doc_id, tf, positions)``: one row per (term, document);
  rows instead of one array per term, so no per-term size limit and no
  skewed per-term collection.
* ``term_stats(term, df)``: document frequency, always re-aggregated.
* ``stats(total_documents, total_terms, last_indexed_at)``: one row, derived.

An index built in this session also keeps its ``tokens(doc_id, pos, term)``, so a
search can filter them to its own terms before any aggregation. A stored index has
``postings_of``, which opens only the parts that hold given terms, and knows its
``total_documents``. ``terms`` is the column that analyzes a row of ``documents``, if its
terms are not stemmed: the store makes postings with it where it has laid the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textindex.functions.stopwords import ENGLISH
from textindex.functions.text import TOKEN_PATTERN
from textindex.operators.analyze import analyze, term_array


@dataclass
class Index:
    documents: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    stats: DataFrame
    tokens: DataFrame | None = None
    postings_of: Callable[[list[str]], DataFrame] | None = None
    total_documents: int | None = None
    terms: Column | None = None


def build_postings(terms: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """F1 + F2: term frequency and sorted positions per (term, document).

    Partial aggregation runs map-side, and the group key includes the document,
    so a frequent term is spread over many groups; each positions array is
    bounded by one document's length.
    """
    return (terms.groupBy("term", doc_col)
            .agg(F.count(F.lit(1)).cast("int").alias("tf"),
                 F.array_sort(F.collect_list("pos")).alias("positions")))


def doc_frequency(postings: DataFrame) -> DataFrame:
    """documents per term (one postings row per document, so a plain count)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index_stats(documents: DataFrame, term_stats: DataFrame,
                indexed_at_col: str | None = None) -> DataFrame:
    """F4 + F10: total documents, distinct terms and last indexing time, one row.

    Both counts are global aggregates with map-side partial counts; nothing is
    collected to one task.
    """
    last = (F.max(indexed_at_col) if indexed_at_col
            else F.lit(None).cast("timestamp"))
    docs = documents.agg(F.count(F.lit(1)).alias("total_documents"),
                         last.alias("last_indexed_at"))
    # one row, so it is broadcast whatever the join settings are
    terms = term_stats.agg(F.count(F.lit(1)).alias("total_terms"))
    return (docs.crossJoin(F.broadcast(terms))
            .select("total_documents", "total_terms", "last_indexed_at"))


def build_index(documents: DataFrame, text_col: str = "content", language: str | None = ENGLISH,
                stopword_list=None, lang_col: str | None = None, stem: bool = False,
                pattern: str = TOKEN_PATTERN, indexed_at_col: str | None = None,
                indexed_at=None) -> Index:
    """G1: analyze every document and derive postings, term_stats and stats.

    ``indexed_at`` (a timestamp or its text) is the time that the documents are
    stamped with, passed in so that a run can be repeated; documents that carry
    their own time keep it in ``indexed_at_col``.
    """
    if indexed_at is not None:
        documents = documents.withColumn("indexed_at", F.lit(indexed_at).cast("timestamp"))
        indexed_at_col = "indexed_at"
    terms = analyze(documents, text_col=text_col, id_cols=("doc_id",), language=language,
                    stopword_list=stopword_list, lang_col=lang_col, stem=stem, pattern=pattern)
    # Whole texts are dealt by id, not their tokens by (term, id): a document's postings
    # are then grouped where its text lies. Stems come with their own exchange.
    used = dict.fromkeys(["doc_id", text_col, *([lang_col] if lang_col is not None else [])])
    postings = build_postings(terms if stem else analyze(
        documents.select(*used).repartition("doc_id"), text_col=text_col, id_cols=("doc_id",), language=language,
        stopword_list=stopword_list, lang_col=lang_col, pattern=pattern))
    term_stats = doc_frequency(postings)
    stats = index_stats(documents, term_stats, indexed_at_col)
    return Index(documents=documents, postings=postings, term_stats=term_stats, stats=stats,
                 tokens=terms, terms=None if stem else term_array(
                     F.col(text_col), language=language, stopword_list=stopword_list,
                     lang_col=lang_col, pattern=pattern))

