"""Index invariants on the sf0.001 documents table."""

from pyspark.sql import functions as F

from conftest import SF001
from textindex.operators.analyze import analyze
from textindex.operators.index import build_index
from textindex.plans.store import reindex
from textindex.sources.tables import corpus_documents


def test_postings_invariants(spark):
    docs = corpus_documents(spark, SF001)
    idx = build_index(docs)
    n_tokens = analyze(docs, "content", ("doc_id",)).count()
    agg = idx.postings.agg(F.sum("tf").alias("s"),
                           F.sum(F.when(F.size("positions") != F.col("tf"), 1).otherwise(0)).alias("bad")).first()
    assert agg.s == n_tokens and agg.bad == 0
    per_term = idx.postings.groupBy("term").count().withColumnRenamed("count", "df")
    assert per_term.exceptAll(idx.term_stats.select("term", "df")).count() == 0


def test_two_increments_equal_one_build(spark):
    docs = corpus_documents(spark, SF001).withColumn("modified_at", F.lit("2024-01-01").cast("timestamp"))
    first = docs.filter(F.col("lang") == "en")
    part = build_index(first)
    both = reindex(part, docs)
    once = build_index(docs)
    cols = ["term", "doc_id", "tf", "positions"]
    assert both.postings.select(cols).exceptAll(once.postings.select(cols)).count() == 0
    assert once.postings.select(cols).exceptAll(both.postings.select(cols)).count() == 0
