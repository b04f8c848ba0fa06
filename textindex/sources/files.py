"""Text and markdown files under a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.functions.text import title_from_text
from textindex.sources import tree

def file_documents(raw: DataFrame) -> DataFrame:
    """Turn rows ``(path, modificationTime, length, content)`` into documents.

    ``(doc_id, source_type='file', url, title, content, file_path, modified_at)``;
    the id is the SHA-256 of the path, so a modified file keeps its id. Invalid UTF-8
    is replaced, never an error.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(
        F.sha2(F.col("path"), 256).alias("doc_id"),
        F.lit("file").alias("source_type"),
        F.col("path").alias("url"),
        title_from_text(text, F.col("path")).alias("title"),
        text.alias("content"),
        F.col("path").alias("file_path"),
        F.col("modificationTime").alias("modified_at"))


def read_text_files(spark: SparkSession, root: str, skip_hidden: bool = False) -> DataFrame:
    """Every ``.txt``/``.md`` file under ``root`` (recursively) as a document.

    Files and folders whose names begin with ``_`` or ``.`` count like any other,
    unless ``skip_hidden`` says to leave them out.
    """
    tree.register(spark)
    return file_documents(spark.read.format(tree.FORMAT).option("skipHidden", str(skip_hidden).lower()).load(root))
