"""Table sources: the parquet tables of a data folder, and the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.functions.text import title_from_text


def read_table(spark: SparkSession, sf_dir: str, name: str,
               num_partitions: int | None = None) -> DataFrame:
    """``spark.read.parquet`` of ``<sf_dir>/<name>.parquet`` (lazy; pruning and
    pushdown happen when a plan uses it).

    ``num_partitions`` deals the rows out anew: for files whose few large row
    groups a scan cannot split. Off by default, whatever the table's size.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df if num_partitions is None else df.repartition(num_partitions)


def corpus_documents(spark: SparkSession, sf_dir: str, num_partitions: int | None = None) -> DataFrame:
    """The ``documents`` table in the document model of the index.

    ``doc_id`` is kept as the key. The table has no path, so the file path is
    derived as ``<source>/<doc_id>.txt``; like an indexed file, its url is its
    path and its title is the first non-blank line (C7). ``num_partitions`` as in
    ``read_table``.
    """
    docs = read_table(spark, sf_dir, "documents", num_partitions)
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        F.col("doc_id"),
        F.lit("file").alias("source_type"),
        path.alias("url"),
        title_from_text(F.col("text"), path).alias("title"),
        F.col("text").alias("content"),
        path.alias("file_path"),
        F.col("lang"),
    )
