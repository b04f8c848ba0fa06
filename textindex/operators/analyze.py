"""The analyze pipeline as DataFrame operators.

``analyze`` turns a text column into one row per kept term with its position in
the filtered stream (positions are assigned after stopword removal, so they do
not reflect the gaps stopwords leave).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.functions.stopwords import ENGLISH, language_column, resolve_language
from textindex.functions.text import TOKEN_PATTERN, analyzed_terms
from textindex.operators.stemming import StemDictionary, stem_tokens


def term_array(text, language: str | None = ENGLISH, stopword_list=None, lang_col=None,
               pattern: str = TOKEN_PATTERN) -> Column:
    """The analyzed terms of ``text``, not stemmed, as one ``array<string>`` column."""
    return analyzed_terms(text, language=language, stopword_list=stopword_list,
                          lang_col=lang_col, pattern=pattern)


def analyze(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",),
            language: str | None = ENGLISH, stopword_list=None, lang_col: str | None = None,
            stem: bool = False, pattern: str = TOKEN_PATTERN,
            dictionary: StemDictionary | None = None) -> DataFrame:
    """Rows ``(*id_cols, pos, term)``, one per kept term, order kept in ``pos``.

    ``language`` picks the stopword list and stemmer for all rows; ``lang_col``
    picks them per row (C6). ``stopword_list=[]`` disables stopwords. ``dictionary``
    keeps the stems of terms for later runs.
    """
    terms = term_array(F.col(text_col), language=language, stopword_list=stopword_list,
                       lang_col=lang_col, pattern=pattern)
    ids = [F.col(c) for c in id_cols]
    if not stem:
        return df.select(*ids, F.posexplode(terms).alias("pos", "term"))
    of_row = (language_column(F.col(lang_col)) if lang_col is not None
              else F.lit(resolve_language(language)))
    used = dict.fromkeys([*id_cols, text_col, *([lang_col] if lang_col is not None else [])])

    def analyzed(rows: DataFrame) -> DataFrame:
        kept = [F.col("_block")] if "_block" in rows.columns else []
        return rows.select(*kept, *ids, of_row.alias("language"), terms.alias("terms"))

    return stem_tokens(df.select(*used), analyzed, dictionary).select(*id_cols, "pos", "term")


def query_term_counts(spark: SparkSession, text: str | None, language: str | None = ENGLISH,
                      stopword_list=None, stem: bool = False) -> dict[str, int]:
    """A query string's terms with their multiplicity, by the same analysis as documents.

    One row goes in, and at most the query's own terms come back.
    """
    row = spark.createDataFrame([(0, text)], "doc_id int, text string")
    terms = analyze(row, language=language, stopword_list=stopword_list, stem=stem)
    return dict(Counter(r["term"] for r in terms.collect()))
