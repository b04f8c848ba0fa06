"""The file source: all files of a tree, in batch and as a stream that restarts."""

import os
import time

import pytest
from pyspark.sql import functions as F

from textindex.operators.index import build_index
from textindex.plans.store import IndexStore
from textindex.sources import tree
from textindex.sources.files import read_text_files
from textindex.streaming.indexer import file_stream, start_indexing_stream

FILES = {"a.txt": "apple", "_notes.md": "notes on apple", ".hidden.txt": "hidden", "_drafts/b.txt": "draft",
         "x/.deep/_c.MD": "deep", "x/Upper.TXT": "upper", "space name é.txt": "odd", "empty.txt": ""}


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


@pytest.fixture()
def root(tmp_dir):
    root = os.path.join(tmp_dir, "files")
    write(root, FILES)
    write(root, {"no.csv": "x", "txt": "x", "y/.md/readme": "x"})
    return root


def contents(root, rows):
    return {os.path.relpath(r.file_path.removeprefix("file:"), root): r.content for r in rows}


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_batch_reads_every_file(spark, root, prefix):
    rows = read_text_files(spark, prefix + root).collect()
    assert contents(root, rows) == FILES and len(rows) == len(FILES)
    assert all(r.file_path.startswith("file:/") and not r.file_path.startswith("file://") for r in rows)
    assert abs(rows[0].modified_at.timestamp() - time.time()) < 600


def test_hidden_files_can_be_left_out(spark, root):
    assert set(contents(root, read_text_files(spark, root, skip_hidden=True).collect())) == {
        "a.txt", "x/Upper.TXT", "space name é.txt", "empty.txt"}


def test_same_rows_as_the_built_in_source(spark, root):
    builtin = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.{txt,TXT}").load(root))
    ours = spark.read.format(tree.FORMAT).option("skipHidden", "true").load(root)
    ours = ours.filter("length > 0")        # the built-in source leaves empty files out
    key = [F.col("path"), F.col("length"), F.col("content")]
    assert sorted(map(tuple, builtin.select(*key).collect())) == sorted(map(tuple, ours.select(*key).collect()))


def test_partitions_are_bounded(spark, root):
    raw = spark.read.format(tree.FORMAT).option("partitionBytes", str(3 << 20)).load(root)
    held = raw.groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in held] == [2] * 4        # a file counts a little over one megabyte
    assert spark.read.format(tree.FORMAT).load(os.path.join(root, "y")).count() == 0


def test_missing_root_is_an_error(spark, tmp_dir):
    with pytest.raises(Exception):
        read_text_files(spark, os.path.join(tmp_dir, "nothing")).collect()


def run_stream(spark, root, place, seen, most=0, fail_at=None):
    """One pass over what exists; the names read by each micro-batch go to ``seen``."""
    def keep(batch, number):
        names = sorted(os.path.relpath(r.path.removeprefix("file:"), root) for r in batch.collect())
        if fail_at is not None:
            raise RuntimeError("lost")
        seen.append((number, names))

    query = (file_stream(spark, root, f"{place}/files", most).writeStream.foreachBatch(keep)
             .option("checkpointLocation", place).trigger(availableNow=True).start())
    query.awaitTermination(120)


def test_stream_loses_and_repeats_nothing(spark, root, tmp_dir):
    place, seen = os.path.join(tmp_dir, "chk"), []
    run_stream(spark, root, place, seen, most=3)
    run_stream(spark, root, place, seen, most=3)
    write(root, {"new/_late.md": "late", "old.txt": "old"})
    os.utime(os.path.join(root, "old.txt"), (1, 1))     # appears with a time long past
    with pytest.raises(Exception, match="lost"):        # the batch is planned but does not end
        run_stream(spark, root, place, seen, fail_at=True)
    run_stream(spark, root, place, seen)
    run_stream(spark, root, place, seen)
    names = [n for _, batch in seen for n in batch]
    assert sorted(names) == sorted([*FILES, "new/_late.md", "old.txt"])
    # a changed file comes again
    write(root, {"a.txt": "banana split"})
    run_stream(spark, root, place, seen)
    assert seen[-1][1] == ["a.txt"]


def test_logged_but_unplanned_files_are_read(root, tmp_dir):
    """The reader dies between writing its log and Spark's: the next one offers the same entry."""
    options = {"path": root, "logLocation": os.path.join(tmp_dir, "log"), "maxFilesPerTrigger": "5"}
    first = tree.TreeStreamReader(options)
    end = first.latestOffset()
    again = tree.TreeStreamReader(options)
    assert [p.files for p in again.partitions(again.initialOffset(), end)] == [
        p.files for p in first.partitions(first.initialOffset(), end)]
    later = again.latestOffset()
    read = [f.path for p in again.partitions({"entry": 0}, later) for f in p.files]
    assert len(read) == len(set(read)) == len(FILES)


def test_stream_indexes_hidden_files(spark, root, tmp_dir):
    store, place = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "chk")
    for files in ({}, {"_more/z.md": "zebra apple"}):
        write(root, files)
        start_indexing_stream(spark, root, store, place, available_now=True).awaitTermination(300)
    index = IndexStore(spark, store).read()
    want = build_index(read_text_files(spark, root))
    def keys(i):
        return sorted((r.term, r.doc_id, r.tf) for r in i.postings.collect())
    assert keys(index) == keys(want) and {t for t, _, _ in keys(index)} >= {"zebra", "notes", "hidden", "draft"}
