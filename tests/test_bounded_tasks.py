"""What one task holds: postings made where the texts lie, batch searches in tasks that follow the rows."""

import os
import random

from pyspark.sql import functions as F

from textindex.operators import inplace, tiles
from textindex.operators import search as S
from textindex.operators.index import build_index
from textindex.plans.store import IndexStore

SCHEMA = "doc_id long, title string, url string, content string"
WORDS = ["cats", "Dogs", "birds", "the", "fish", "newts", "é"]


def rows(frame):
    return sorted((str(r.doc_id), r.term, r.tf, tuple(r.positions)) for r in frame.collect())


def documents(spark, repeats=False):
    rng = random.Random(4)
    found = [(i, "t", "u", " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(60)]
    found += [(100, "t", "u", None), (101, "t", "u", "")]
    if repeats:
        found += [(3, "t", "u", "cats cats owls"), (3, "t", "u", "owls"), (None, "t", "u", "cats"), (None, "t", "u", "fish cats")]
    return spark.createDataFrame(found, SCHEMA)


def test_postings_are_made_without_an_exchange(spark):
    index = build_index(documents(spark))
    held = inplace.STEP_TOKENS
    try:
        for inplace.STEP_TOKENS in (1, 30, held):
            found = inplace.postings_in_place(index.documents.coalesce(2), index.terms, ("title",))
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            assert found.columns == ["title", "term", "doc_id", "tf", "positions"]
            assert rows(found) == rows(index.postings)
    finally:
        inplace.STEP_TOKENS = held


def test_stored_postings_of_repeated_and_null_ids(spark, tmp_dir):
    index = build_index(documents(spark, repeats=True))
    store = IndexStore(spark, os.path.join(tmp_dir, "store"), buckets=3)
    store.write(index)
    assert rows(store.read().postings) == rows(index.postings)
    assert rows(store.read().postings_of(["cats", "owls"])) == rows(index.postings.filter("term IN ('cats', 'owls')"))
    assert store.read().documents.count() == index.documents.count()


def test_a_task_takes_a_tile(spark):
    docs = spark.range(600).selectExpr("id AS d", "id % 7 AS t", "1 AS tf")
    asked = spark.range(7).selectExpr("id AS q", "id AS t", "1D AS weight")
    found = tiles.tile_scores(docs, asked, 3, 6, 16, 2, doc_rows=20)
    assert found.rdd.getNumPartitions() == 30
    assert found.groupBy("q").count().filter("count < 3").count() == 0


def test_matches_are_dealt_over_the_tasks_asked_for(spark):
    index = build_index(documents(spark))
    found = S._matches(index, lambda tokens: tokens.filter(F.col("term") == "cats"), tasks=23)
    assert found.rdd.getNumPartitions() == 23
    assert sorted(r.doc_id for r in found.collect()) == sorted(
        r.doc_id for r in index.postings.filter("term = 'cats'").collect())


def test_tiles_are_not_written_for_each_pair(spark):
    """Disk follows the rows, not the pairs of tiles: 80 tiles of documents by 20 of queries."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(d, t, 1) for d in range(800) for t in rng.sample(range(200), 20)], "d long, t long, tf int")
    asked = spark.createDataFrame([(q, t, 1.0 + t / 1000) for q in range(400) for t in rng.sample(range(200), 10)],
                                  "q long, t long, weight double")

    def disk():
        shuffled = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())
        kept = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return sum(f.length() for f in shuffled) + sum(
            os.path.getsize(os.path.join(top, name)) for top, _, names in os.walk(kept) for name in names)

    before = disk()
    found = tiles.tile_scores(docs, asked, 3, 6, 16, 2, doc_rows=200, query_rows=200).collect()
    used = disk() - before
    assert used < 64 * (docs.count() + asked.count()), used
    held, best = {}, {}
    for r in docs.collect():
        held.setdefault(r.d, set()).add(r.t)
    for r in asked.collect():
        for d, terms in held.items():
            if r.t in terms:
                best.setdefault(r.q, {}).setdefault(d, []).append(r.weight)
    got = {}
    for r in found:
        got.setdefault(r.q, []).append((-round(r.score, 6), r.d))
    assert {q: sorted(x)[:3] for q, x in got.items()} == {
        q: sorted((-round(sum(w), 6), d) for d, w in x.items())[:3] for q, x in best.items()}


def test_pieces_of_a_document_meet_in_one_tile(spark, monkeypatch):
    monkeypatch.setattr(tiles, "PIECE_ROWS", 3)
    rows = [(d, t, 1 + n % 2) for n in range(3) for d in ("a", "b", "é", None) for t in range(n, 6)]
    packed = tiles.pack_documents(spark.createDataFrame(rows, "d string, t int, tf int").repartition(5), 2, doc_rows=8)
    want, got = {}, {}
    for d, t, tf in rows:
        want.setdefault(d, {}).setdefault(t, 0)
        want[d][t] += tf
    for r in packed.collect():
        tile = tiles.Lists.of(tiles.unpacked(bytes(r.tile)), "d", "tf")
        for n, d in enumerate(tile.ids.to_pylist()):
            assert d not in got
            at = slice(tile.cuts[n], tile.cuts[n + 1])
            got[d] = dict(zip(tile.t[at].tolist(), tile.values[at].tolist()))
    assert got == want
    assert {r.t: r.df for r in tiles.document_counts(packed).collect()} == {t: 4 for t in range(6)}


def test_terms_are_numbered_from_zero_in_their_order(spark):
    names = [f"w{i:03d}" for i in range(70)]
    found = S.numbered(spark.createDataFrame([(x,) for x in names[::-1] * 2], "term string"), "term", "t").collect()
    assert sorted((r.t, r.term) for r in found) == list(enumerate(names))
    assert S.numbered(spark.createDataFrame([], "term string"), "term", "t").count() == 0
