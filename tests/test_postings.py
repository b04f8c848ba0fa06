"""Postings are grouped where a document's text lies."""

from textindex.operators.index import build_index

ROWS = [(1, "t", "u", "cats dogs cats"), (1, "t", "u", "dogs"), (None, "t", "u", "cats"), (None, "t", "u", "cats birds"),
        (2, "t", "u", None), (3, "t", "u", "")]


def test_texts_are_shuffled_by_id_and_tokens_are_not(spark):
    postings = build_index(spark.createDataFrame(
        ROWS, "doc_id long, title string, url string, content string")).postings
    exchanges = [line for line in postings._jdf.queryExecution().executedPlan().toString().split("\n")
                 if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(doc_id" in exchanges[0]


def test_repeated_and_null_ids_are_one_document_each(spark):
    postings = build_index(spark.createDataFrame(
        ROWS, "doc_id long, title string, url string, content string")).postings
    assert {(r.doc_id, r.term, r.tf, tuple(r.positions)) for r in postings.collect()} == {
        (1, "cats", 2, (0, 2)), (1, "dogs", 2, (0, 1)), (None, "cats", 2, (0, 0)), (None, "birds", 1, (1,))}
