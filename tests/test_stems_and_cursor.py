"""The kept stem dictionary, and paging by cursor."""

import os

from pyspark.sql import functions as F

from textindex.operators import stemming
from textindex.operators.analyze import analyze
from textindex.operators.index import build_index
from textindex.operators.search import cursor, search, search_after
from textindex.operators.stemming import StemDictionary


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "es" if i % 3 == 0 else "en") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string")


TEXTS = ["corriendo rápidamente canciones", "running quickly cats", "the cats ran; running runs", None, "",
         "nacionales gatos", "skies dying happiness"] + ["common running words"] * 50


def stemmed(df, **kwargs):
    return sorted(map(tuple, analyze(df, lang_col="lang", stem=True, **kwargs).collect()))


def test_only_unseen_terms_are_stemmed(spark, tmp_dir):
    kept = StemDictionary(spark, os.path.join(tmp_dir, "stems"))
    want = stemmed(docs(spark, TEXTS))
    assert ("run" in {r[2] for r in want}) and kept.read().count() == 0
    assert stemmed(docs(spark, TEXTS[:3]), dictionary=kept) == stemmed(docs(spark, TEXTS[:3]))
    before = kept.read().count()
    assert stemmed(docs(spark, TEXTS), dictionary=kept) == want
    parts = [spark.read.parquet(os.path.join(tmp_dir, "stems", p)).count() for p in os.listdir(os.path.join(tmp_dir, "stems"))]
    assert sorted(parts) == sorted([before, kept.read().count() - before])       # nothing twice
    assert stemmed(docs(spark, TEXTS), dictionary=kept) == want
    assert kept.read().count() == sum(parts)


def test_tokens_are_not_shuffled_below_the_bound(spark):
    plan = analyze(docs(spark, TEXTS), lang_col="lang", stem=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_salted_shuffle_beyond_the_bound(spark):
    want, held = stemmed(docs(spark, TEXTS)), stemming.BROADCAST_BYTES
    stemming.BROADCAST_BYTES = 0
    try:
        assert stemmed(docs(spark, TEXTS)) == want
    finally:
        stemming.BROADCAST_BYTES = held


def test_pages_by_cursor_are_pages_by_offset(spark):
    rows = spark.range(95).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.lit("u").alias("url"),
                                  F.repeat(F.lit("apple "), (F.col("id") % 4).cast("int")).alias("content"))
    index = build_index(rows)
    after, number = None, 0
    while True:
        page = search_after(index, "apple", after, limit=20).collect()
        number += 1
        assert page == search(index, "apple", number, 20).collect()
        if not page:
            break
        after = cursor(page)
    assert number == 5 and cursor([]) is None
    plan = search_after(index, "apple", (1.0, 50, 40), limit=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 20" in plan and "Offset" not in plan


def test_tokens_are_not_shuffled_beyond_the_bound(spark, tmp_dir):
    want, held, size = stemmed(docs(spark, TEXTS)), stemming.BROADCAST_BYTES, stemming.BLOCK_BYTES
    stemming.BROADCAST_BYTES, stemming.BLOCK_BYTES = 0, 64
    try:
        found = analyze(docs(spark, TEXTS), lang_col="lang", stem=True)
        assert stemmed(docs(spark, TEXTS), dictionary=StemDictionary(spark, os.path.join(tmp_dir, "stems"))) == want
    finally:
        stemming.BROADCAST_BYTES, stemming.BLOCK_BYTES = held, size
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Exchange" in line or "CoGroups" in line]
    assert any("CoGroups" in line for line in joins)
    assert not any("pos#" in line or "doc_id#" in line for line in joins if "Exchange" in line)
    assert "_salt" not in plan
