"""Search over a small file tree: hand-computed TF-IDF, paging, envelope, store, re-index, stream."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from textindex.operators.index import build_index
from textindex.operators.search import (batch_search, score_documents, search, search_envelope,
                                        search_total, validate_paging)
from textindex.operators.web import page_documents
from textindex.plans.store import IndexStore, reindex
from textindex.sources.files import file_documents, read_text_files
from textindex.streaming.indexer import start_indexing_stream

CORPUS = {
    "doc1.txt": "apple apple apple fruit",
    "doc2.txt": "fruit fruit apple",
    "index.txt": "This a text",
    "newfile.txt": "This a text file made for the search engine motives",
    "sub/plan.MD": "\n\n  # Project Plan\nindexing and ranking of pages\n",
}


def write_tree(root, files):
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as f:
            f.write(text)


@pytest.fixture()
def corpus_dir(tmp_dir):
    root = os.path.join(tmp_dir, "data")
    write_tree(root, CORPUS)
    write_tree(root, {"ignored.csv": "apple,apple"})
    with open(os.path.join(root, "blank.txt"), "w") as f:
        f.write("   \n\n")
    with open(os.path.join(root, "bad.txt"), "wb") as f:
        f.write(b"ok \xff\xfe apple")
    return root


def scores(index, q):
    return {os.path.basename(r.doc_url): round(r.score, 6) for r in
            score_documents(index, q).join(index.documents.select("doc_id", F.col("url").alias("doc_url")), "doc_id").collect()}


def test_file_source(spark, corpus_dir):
    docs = {os.path.basename(r.file_path): r for r in read_text_files(spark, corpus_dir).collect()}
    assert set(docs) == {"doc1.txt", "doc2.txt", "index.txt", "newfile.txt", "plan.MD", "blank.txt", "bad.txt"}
    assert docs["plan.MD"].title == "# Project Plan"
    assert docs["blank.txt"].title == "blank.txt"
    assert "�" in docs["bad.txt"].content


def test_hand_computed_scores(spark, corpus_dir):
    docs = read_text_files(spark, corpus_dir).filter(~F.col("file_path").rlike("(blank|bad)\\.txt$"))
    index = build_index(docs)
    assert scores(index, "apple") == {"doc1.txt": 3.758289, "doc2.txt": 1.252763}
    assert scores(index, "apple fruit") == {"doc1.txt": 5.011052, "doc2.txt": 3.758289}
    assert scores(index, "apple apple") == {"doc1.txt": 7.516578, "doc2.txt": 2.505526}
    assert scores(index, "the of and") == {}
    assert scores(index, "unknownterm apple")["doc1.txt"] == 3.758289


def test_paging_and_envelope(spark, corpus_dir):
    index = build_index(read_text_files(spark, corpus_dir))
    full = [r.doc_id for r in search(index, "apple fruit text", 1, 100).collect()]
    paged = [r.doc_id for p in (1, 2, 3) for r in search(index, "apple fruit text", p, 2).collect()]
    assert paged == full and len(full) == search_total(index, "apple fruit text").first().total
    env = json.loads(search_envelope(index, "apple", 1, 1).first().response)
    assert env["page"] == 1 and env["limit"] == 1 and env["total"] == 3 and len(env["data"]) == 1
    assert set(env["data"][0]) == {"docID", "title", "url"}
    empty = json.loads(search_envelope(index, "the", 1, 10).first().response)
    assert "data" not in empty and empty["total"] == 0
    for bad in ((0, 10), (1, 0), ("x", 10), (1.5, 10)):
        with pytest.raises(ValueError):
            validate_paging(*bad)


def test_batch_equals_single(spark, corpus_dir):
    index = build_index(read_text_files(spark, corpus_dir))
    qs = spark.createDataFrame([(1, "apple"), (2, "apple apple fruit"), (3, "the"), (4, "")],
                               "query_id long, text string")
    got = {}
    for r in batch_search(index, qs, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for qid, text in ((1, "apple"), (2, "apple apple fruit")):
        single = [(r.rank, r.doc_id, r.score) for r in search(index, text, 1, 10).collect()]
        assert sorted(got[qid]) == single
    assert 3 not in got and 4 not in got


def _postings(index):
    return sorted((r.term, r.doc_id, r.tf, tuple(r.positions)) for r in index.postings.collect())


def test_store_roundtrip_and_reindex(spark, corpus_dir, tmp_dir):
    docs = read_text_files(spark, corpus_dir)
    store = IndexStore(spark, os.path.join(tmp_dir, "store"), buckets=4)
    v1 = store.write(build_index(docs))
    assert _postings(store.read(v1)) == _postings(build_index(docs))
    time.sleep(1.1)
    write_tree(corpus_dir, {"doc1.txt": "banana split", "added.txt": "apple pie"})
    new = reindex(store.read(), read_text_files(spark, corpus_dir))
    v2 = store.write(new)
    assert store.current_version() == v2 != v1
    fresh = build_index(read_text_files(spark, corpus_dir))
    assert _postings(store.read()) == _postings(fresh)
    tf = {r.term: r.df for r in store.read().term_stats.collect()}
    assert tf["apple"] == {r.term: r.df for r in fresh.term_stats.collect()}["apple"]
    assert store.read().stats.first().total_documents == fresh.documents.count()


def _files(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs}


def test_update_rewrites_only_touched_buckets(spark, corpus_dir, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    store = IndexStore(spark, root, buckets=16)
    store.write(build_index(read_text_files(spark, corpus_dir)))
    first = store.manifest()
    time.sleep(1.1)
    write_tree(corpus_dir, {"doc1.txt": "banana split"})
    store.update(read_text_files(spark, corpus_dir))
    second = store.manifest()
    assert second.version > first.version and second.buckets == 16
    changed = {b for b in second.segments if second.segments[b] != first.segments.get(b)}
    assert len(changed) == 1
    new = next(iter({second.segments[b] for b in changed}))
    assert {f.split("bucket=")[1].split("/")[0] for f in _files(f"{root}/segments/{new}") if "bucket=" in f} == {
        str(b) for b in changed}
    assert _postings(store.read()) == _postings(build_index(read_text_files(spark, corpus_dir)))
    # the same batch again changes nothing
    assert store.update(read_text_files(spark, corpus_dir)) == second.version


def test_stored_lookup_reaches_the_scan(spark, corpus_dir, tmp_dir):
    store = IndexStore(spark, os.path.join(tmp_dir, "store"), buckets=4)
    store.write(build_index(read_text_files(spark, corpus_dir), indexed_at="2024-05-06 07:08:09"))
    index = store.read()
    assert str(index.stats.first().last_indexed_at) == "2024-05-06 07:08:09"
    found = index.postings.filter(F.col("term").isin("apple", "fruit"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [apple,fruit])]" in plan
    assert {r.term for r in found.collect()} == {"apple", "fruit"}
    assert scores(index, "apple") == scores(build_index(read_text_files(spark, corpus_dir)), "apple")


def test_removal_that_empties_a_bucket(spark, corpus_dir, tmp_dir):
    store = IndexStore(spark, os.path.join(tmp_dir, "store"), buckets=4096)    # so that no two files share one
    docs = read_text_files(spark, corpus_dir)
    store.write(build_index(docs))
    before = store.manifest()
    path = [r.file_path for r in docs.collect() if r.file_path.endswith("doc2.txt")]
    store.update(docs.limit(0), removed_paths=path)
    after = store.manifest()
    assert len(after.segments) < len(before.segments)
    rest = docs.filter(~F.col("file_path").endswith("doc2.txt"))
    assert _postings(store.read()) == _postings(build_index(rest))


def test_failed_write_is_not_seen_and_a_retry_works(spark, corpus_dir, tmp_dir):
    store = IndexStore(spark, os.path.join(tmp_dir, "store"), buckets=4)
    index = build_index(read_text_files(spark, corpus_dir))
    store.write(index)
    version = store.current_version()
    broken = build_index(index.documents.withColumn("content", F.raise_error("lost").cast("string")))
    with pytest.raises(Exception, match="lost"):
        store.write(broken)
    assert store.current_version() == version
    assert store.write(index) > version


def test_unreadable_root_is_an_error(spark, tmp_dir):
    assert IndexStore(spark, os.path.join(tmp_dir, "nothing")).current_version() is None
    with pytest.raises(Exception):
        IndexStore(spark, "nosuchscheme://host/x").current_version()


def test_frequent_term_is_spread_over_tasks(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.lit("u").alias("url"),
        F.concat(F.lit("common word"), F.repeat(F.lit("x"), (F.col("id") % 5).cast("int"))).alias("content"))
    index = build_index(docs)
    from textindex.operators import search as S
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # 400 rows are few
    matches = S._matches(index, lambda rows: rows.filter(F.col("term").isin("common")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    tasks = matches.select(F.spark_partition_id().alias("p")).distinct().count()
    assert matches.count() == 400 and tasks > 1
    queries = spark.createDataFrame([(1, "common"), (2, "wordx common common")], "query_id long, text string")
    small = sorted(map(tuple, S.batch_search(index, queries, k=5).collect()))
    held, S.BROADCAST_BYTES = S.BROADCAST_BYTES, 0
    try:      # the same through salted shuffles
        assert sorted(map(tuple, S.batch_search(index, queries, k=5).collect())) == small
    finally:
        S.BROADCAST_BYTES = held


def test_latest_page_that_is_long_enough_wins(spark):
    pages = spark.createDataFrame([(1, "http://h/a", "<body>" + "long " * 40), (2, "http://h/a", "<body>short")],
                                  "page_id long, url string, html string")
    assert [(r.doc_id, len(r.content)) for r in page_documents(pages).collect()] == [(1, 199)]


def test_stream_indexes_directory(spark, corpus_dir, tmp_dir):
    store_root = os.path.join(tmp_dir, "stream-store")
    q = start_indexing_stream(spark, corpus_dir, store_root, os.path.join(tmp_dir, "chk"),
                              available_now=True, max_files_per_trigger=3)
    q.awaitTermination(300)
    store = IndexStore(spark, store_root)
    assert store.current_version() is not None
    assert _postings(store.read()) == _postings(build_index(read_text_files(spark, corpus_dir)))
