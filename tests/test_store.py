"""The stored index: lookups by term, statistics and change scans read what they need."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from textindex.operators.index import build_index, doc_frequency
from textindex.operators.search import search
from textindex.plans.store import IndexStore, part_number, part_of

WORDS = ["apple", "banana", "cherry", "damson", "elder", "fig", "grape", "hazel"]
SCHEMA = "doc_id long, source_type string, url string, title string, content string, file_path string, modified_at string"


def documents(spark, texts, at="2024-01-01 00:00:00"):
    rows = [(i, "file", f"p/{i}.txt", f"t{i}", t, f"p/{i}.txt", at) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).withColumn("modified_at", F.col("modified_at").cast("timestamp"))


def text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))


def postings(frame):
    return sorted((r.term, r.doc_id, r.tf, tuple(r.positions)) for r in frame.collect())


def folders(frame, name):
    return sorted({int(m[1]) for f in frame.inputFiles() if (m := re.search(rf"/{name}=(\d+)/", f))})


@pytest.fixture()
def store(spark, tmp_dir):
    rng = random.Random(1)
    texts = {i: text(rng) for i in range(200)}
    made = IndexStore(spark, os.path.join(tmp_dir, "store"), buckets=4, parts=32)
    made.write(build_index(documents(spark, texts), indexed_at="2024-05-06 07:08:09"))
    return made, texts


def test_a_lookup_opens_the_parts_of_its_terms(spark, store):
    made, texts = store
    index, fresh = made.read(), build_index(documents(spark, texts))
    for terms in (["apple", "fig", "grape"], ["nowhere"], ["apple", "nowhere"]):
        found = index.postings_of(terms)
        assert postings(found) == postings(fresh.postings.filter(F.col("term").isin(terms)))
        held = {part_number(w, 32) for w in WORDS}
        assert folders(found, "term_part") == sorted({part_number(t, 32) for t in terms} & held)
    for query in ("apple fig grape", "apple apple", "nowhere"):
        assert search(index, query).collect() == search(fresh, query).collect()


def test_parts_are_the_same_in_both_languages(spark):
    names = ["apple", "é ß", "", "日本", "p/1.txt"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(part_of(F.col("n"), 97)).collect()
    assert [r[0] for r in got] == [part_number(n, 97) for n in names]


def test_statistics_read_no_postings(spark, store):
    made, texts = store
    index = made.read()
    for frame in (index.stats, index.term_stats):
        assert frame.inputFiles() and all("/term_counts/" in f for f in frame.inputFiles())
    row = index.stats.first()
    assert (row.total_documents, row.total_terms, str(row.last_indexed_at)) == (200, 8, "2024-05-06 07:08:09")
    assert sorted(map(tuple, index.term_stats.collect())) == sorted(map(tuple, doc_frequency(index.postings).collect()))


def test_one_changed_file_reads_one_part(spark, store):
    made, texts = store
    incoming = documents(spark, {17: "changed"}, "2024-02-01 00:00:00")
    stored = made.stored_paths(made.manifest(), incoming)
    assert folders(stored, "path_part") == [part_number("p/17.txt", 32)]
    assert not any("/documents/" in f for f in stored.inputFiles())
    before = made.manifest()
    made.update(incoming)
    after = made.manifest()
    assert len({b for b in after.segments if after.segments[b] != before.segments[b]}) == 1
    assert postings(made.read().postings) == postings(build_index(documents(spark, texts | {17: "changed"})).postings)


def test_ten_updates_with_removals(spark, tmp_dir):
    rng = random.Random(2)
    texts = {i: text(rng) for i in range(200)}
    made = IndexStore(spark, os.path.join(tmp_dir, "store"), buckets=3, parts=2)
    made.write(build_index(documents(spark, texts)))
    for step in range(10):
        at = f"2024-03-{step + 1:02d} 00:00:00"
        new = {rng.randint(0, 260): text(rng) for _ in range(3)}
        lost = rng.sample(sorted(set(texts) - set(new)), 2)
        made.update(documents(spark, new, at), removed_paths=[f"p/{i}.txt" for i in lost])
        texts = {i: t for i, t in (texts | new).items() if i not in lost}
    index, fresh = made.read(), build_index(documents(spark, texts))
    assert postings(index.postings) == postings(fresh.postings)
    assert postings(index.postings_of(WORDS)) == postings(fresh.postings)
    assert sorted(map(tuple, index.term_stats.collect())) == sorted(map(tuple, fresh.term_stats.collect()))
    row = index.stats.first()
    assert (row.total_documents, row.total_terms) == (len(texts), fresh.term_stats.count())
    assert index.documents.count() == len(texts)
    assert search(index, "fig grape").collect() == search(fresh, "fig grape").collect()


def test_buckets_follow_the_documents(spark, tmp_dir):
    rng = random.Random(3)
    texts = {i: text(rng) for i in range(10)}
    made = IndexStore(spark, os.path.join(tmp_dir, "store"), docs_per_bucket=10)
    made.write(build_index(documents(spark, texts)))
    assert made.manifest().buckets == 1
    new = {i: text(rng) for i in range(10, 60)}
    made.update(documents(spark, new))
    assert made.manifest().buckets == 6 and len(made.manifest().segments) > 1
    assert postings(made.read().postings) == postings(build_index(documents(spark, texts | new)).postings)
    made.write(made.read())
    assert made.manifest().buckets == 6


def test_a_replayed_batch_is_known_by_name(spark, store):
    made, _ = store
    first = made.update(documents(spark, {1: "one"}, "2024-02-01 00:00:00"), batch="s#4")
    assert made.update(documents(spark, {1: "never read"}, "2025-01-01 00:00:00"), batch="s#4") == first
    assert made.update(documents(spark, {1: "read"}, "2025-01-01 00:00:00"), batch="s#5") != first
    assert [r.term for r in made.read().postings.filter("doc_id = 1").collect()] == ["read"]


def test_no_terms_and_no_documents(spark, tmp_dir):
    made = IndexStore(spark, os.path.join(tmp_dir, "store"))
    made.write(build_index(documents(spark, {1: "the", 2: ""})))
    index = made.read()
    assert index.postings.collect() == [] and index.postings.schema["doc_id"].dataType.simpleString() == "bigint"
    assert index.stats.first().total_documents == 2 and index.stats.first().total_terms == 0
    assert search(index, "apple").collect() == []
    made.update(documents(spark, {}), removed_paths=["p/1.txt", "p/2.txt", "p/none.txt"])
    with pytest.raises(FileNotFoundError):
        made.read()
    made.update(documents(spark, {3: "apple"}))
    assert [r.doc_id for r in search(made.read(), "apple").collect()] == [3]
