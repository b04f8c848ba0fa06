"""Column expressions for text analysis (tokenize, normalize, stopwords, titles, IDF).

All of these are built-in Spark SQL expressions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textindex.functions.stopwords import ENGLISH, SPANISH, language_column, stopwords

# A token is a run of ASCII letters. This mirrors POSIX [[:alpha:]] in an
# ASCII-only regex engine: digits, apostrophes, hyphens and accented letters all
# split tokens ("Aquí aren't" -> Aqu, aren, t).
TOKEN_PATTERN = "[A-Za-z]+"

# Go's unicode.IsSpace set, spelled out because Java's \s and RE2's \s differ.
WHITESPACE_CLASS = (r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text, pattern: str = TOKEN_PATTERN) -> Column:
    """Every match of ``pattern`` in ``text``, in order (empty array for null)."""
    return F.coalesce(F.regexp_extract_all(_col(text), F.lit(pattern), 0),
                      F.array().cast("array<string>"))


def normalize(tokens, pattern: str = TOKEN_PATTERN) -> Column:
    """C2 + D7: lowercase each token and drop empty ones.

    With the default pattern a token is letters only, so lowercasing is all there
    is to do. For a custom pattern, characters other than letters and '-' are
    removed as well.
    """
    if pattern == TOKEN_PATTERN:
        lowered = F.transform(_col(tokens), lambda t: F.lower(t))
    else:
        lowered = F.transform(_col(tokens),
                              lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\-]", ""))
    return F.filter(lowered, lambda t: t != F.lit(""))


def drop_stopwords(tokens, words: Iterable[str]) -> Column:
    """Remove tokens found in ``words``.

    ``isin`` over a literal list is rewritten by Catalyst into a hash-set lookup
    (InSet), so the cost per token does not grow with the list.
    """
    words = list(words)
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~t.isin(words))


def drop_stopwords_by_language(tokens, lang) -> Column:
    """Per-row stopword list chosen by a ``lang`` column (Spanish or English)."""
    lang_col = language_column(_col(lang))
    return (F.when(lang_col == F.lit(SPANISH), drop_stopwords(tokens, stopwords(SPANISH)))
            .otherwise(drop_stopwords(tokens, stopwords(ENGLISH))))


def analyzed_terms(text, language: str | None = ENGLISH, stopword_list=None,
                   lang_col=None, pattern: str = TOKEN_PATTERN) -> Column:
    """C1 -> C2 -> D7 -> C3 as one array expression (no stemming).

    ``stopword_list`` overrides the language's list (``[]`` disables it);
    ``lang_col`` selects the list per row.
    """
    terms = normalize(tokenize(text, pattern), pattern)
    if lang_col is not None:
        return drop_stopwords_by_language(terms, lang_col)
    words = stopwords(language) if stopword_list is None else stopword_list
    return drop_stopwords(terms, words)


def title_from_text(text, path) -> Column:
    """First line that is non-blank after trimming, else the file's base name.

    One anchored regex: skip leading whitespace (blank lines included), take the
    rest of that line, trim its end. No per-line split of the whole text.
    """
    first = trim_go(F.regexp_extract(_col(text), FIRST_LINE_PATTERN, 1))
    return F.coalesce(F.nullif(first, F.lit("")), F.element_at(F.split(_col(path), "/"), -1))


FIRST_LINE_PATTERN = f"^{WHITESPACE_CLASS}*([^\n]*)"


def trim_go(c) -> Column:
    """Trim leading and trailing Unicode whitespace (Go's strings.TrimSpace)."""
    return F.regexp_replace(_col(c), f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")


def collapse_whitespace(c) -> Column:
    """Split on whitespace runs and rejoin with single spaces (strings.Fields + Join)."""
    return trim_go(F.regexp_replace(_col(c), f"{WHITESPACE_CLASS}+", " "))


def word_count(c) -> Column:
    """Number of whitespace-separated fields."""
    return F.size(F.filter(F.split(_col(c), f"{WHITESPACE_CLASS}+"), lambda x: x != F.lit("")))


def idf(df_col, n_col) -> Column:
    """Smooth IDF ``ln(1 + N/df)``; 0 when df or N is 0."""
    df_c, n_c = _col(df_col), _col(n_col)
    return (F.when((df_c == 0) | (n_c == 0), F.lit(0.0))
            .otherwise(F.log(F.lit(1.0) + n_c.cast("double") / df_c.cast("double"))))
