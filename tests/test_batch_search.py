"""Pruned batch search: same top documents as scoring all, for a fraction of the pairs."""

import random

import pytest
from pyspark.sql import functions as F

from textindex.operators import search as S
from textindex.operators.index import build_index
from textindex.sources.tables import corpus_documents

SF01 = "/root/testdata/sf0.01"


def top(scores, k):
    found = {}
    for r in scores.collect():
        found.setdefault(r.query_id, []).append((-round(r.score, 6), r.doc_id))
    return {q: sorted(rows)[:k] for q, rows in found.items()}


@pytest.mark.parametrize("table", ["benchmark", "conversations"])
def test_a_quarter_of_the_pairs_at_most(spark, table):
    rows = spark.read.parquet(f"{SF01}/{table}.parquet")
    queries = (rows.select(F.col("item_id").alias("query_id"), "text") if table == "benchmark" else
               rows.select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), "text"))
    index = build_index(corpus_documents(spark, SF01))
    every = S.batch_scores(index, queries).checkpoint()
    pruned = S.batch_top_scores(index, queries, k=10).checkpoint()
    assert pruned.count() == pruned.select("query_id", "doc_id").distinct().count()
    assert pruned.count() * 4 <= every.count()
    assert top(pruned, 10) == top(every, 10)


def test_ties_small_blocks_and_shuffles(spark):
    rng = random.Random(6)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    docs = [(i, "t", "u", " ".join(rng.choice(words[:rng.randint(1, 12)]) for _ in range(rng.randint(0, 12))))
            for i in range(150)] + [(150 + i, "t", "u", "wa wb wb") for i in range(30)]
    index = build_index(spark.createDataFrame(docs, "doc_id long, title string, url string, content string"))
    queries = spark.createDataFrame(
        [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for i in range(25)]
        + [(25, None), (26, "nowhere"), (27, "wa wb wb"), (None, "wc wd")], "query_id long, text string")
    want = top(S.batch_scores(index, queries).checkpoint(), 7)
    for options in ({}, {"block_docs": 1, "first_blocks": 1}, {"block_docs": 64, "first_blocks": 2}):
        assert top(S.batch_top_scores(index, queries, k=7, **options), 7) == want
    held, S.BROADCAST_BYTES = S.BROADCAST_BYTES, 0
    try:
        assert top(S.batch_top_scores(index, queries, k=7, first_blocks=3), 7) == want
    finally:
        S.BROADCAST_BYTES = held
    got = {}
    for r in S.batch_search(index, queries, k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.doc_id))
    assert {q: [x[1:] for x in sorted(rows)] for q, rows in got.items()} == want


def test_copies_are_returned_k_times_at_most_in_a_tile(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'t' AS title", "'u' AS url",
                                       "IF(id % 4 = 3, 'wa wb', 'wb wb wa') AS content")
    queries = spark.createDataFrame([(1, "wa wb"), (2, "wa")], "query_id long, text string")
    rows = S.batch_top_scores(build_index(docs), queries, k=5).checkpoint()
    assert rows.count() <= 2 * 2 * 5
    assert {(r.query_id, r["rank"], r.doc_id) for r in S.batch_search(build_index(docs), queries, k=5).collect()} == {
        (q, n + 1, d) for q, ids in ((1, [0, 1, 2, 4, 5]), (2, [0, 1, 2, 3, 4])) for n, d in enumerate(ids)}


@pytest.mark.parametrize("dense", [0, 512])
def test_tiles_give_the_best_of_brute_force(spark, dense):
    from textindex.operators import tiles

    rng = random.Random(3)
    docs = [(d, t, rng.randint(1, 3)) for d in range(90) for t in rng.sample(range(40), rng.randint(1, 12))]
    queries = [(q, t, rng.random()) for q in range(300) for t in rng.sample(range(45), rng.randint(1, 9))]
    held, tiles.DENSE_TERMS, tiles.STEP_PAIRS, old = tiles.DENSE_TERMS, dense, 50, tiles.STEP_PAIRS
    try:
        found = tiles.tile_scores(spark.createDataFrame(docs, "d long, t long, tf int"),
                                  spark.createDataFrame(queries, "q long, t long, weight double"),
                                  4, 6, 16, 2, doc_rows=200, query_rows=500).collect()
    finally:
        tiles.DENSE_TERMS, tiles.STEP_PAIRS = held, old
    want, got = {}, {}
    for q, t, w in queries:
        for d, u, tf in docs:
            if t == u:
                want.setdefault(q, {}).setdefault(d, 0.0)
                want[q][d] += w * tf
    for q, d, s in found:
        got.setdefault(q, {})[d] = s
    best = {q: sorted(((-round(s, 6), d) for d, s in rows.items()))[:4] for q, rows in want.items()}
    assert {q: sorted(((-round(s, 6), d) for d, s in rows.items()))[:4] for q, rows in got.items()} == best
