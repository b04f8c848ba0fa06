"""Stopword lists (data files) and language selection."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATA = Path(__file__).resolve().parent.parent / "data"

ENGLISH = "english"
SPANISH = "spanish"


@lru_cache(maxsize=None)
def stopwords(language: str) -> tuple[str, ...]:
    """The stopword list for ``english`` or ``spanish``, in file order."""
    code = "es" if resolve_language(language) == SPANISH else "en"
    lines = (_DATA / f"stopwords_{code}.txt").read_text(encoding="utf-8").splitlines()
    return tuple(w for w in lines if w and not w.startswith("#"))


def resolve_language(language: str | None) -> str:
    """``spanish`` (any case, or the code ``es``) selects Spanish; all else English."""
    if language is not None and language.strip().lower() in (SPANISH, "es"):
        return SPANISH
    return ENGLISH


def language_column(lang: Column) -> Column:
    """Per-row form of :func:`resolve_language` for a ``lang`` column."""
    return (F.when(F.lower(F.trim(lang)).isin(SPANISH, "es"), F.lit(SPANISH))
            .otherwise(F.lit(ENGLISH)))
