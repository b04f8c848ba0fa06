"""textindex: text indexing and TF-IDF search as Spark DataFrame jobs."""

from textindex.operators.index import Index, build_index
from textindex.operators.search import batch_search, search, search_envelope, search_total

__all__ = ["Index", "build_index", "search", "search_total", "search_envelope", "batch_search"]
