"""The crawl schedule as a stream: same offsets as the batch operator, across a restart."""

import os
import random
import time

from pyspark.sql import functions as F

from textindex.operators.crawl import crawl_schedule
from textindex.streaming.schedule import next_slots, start_schedule_stream

SCHEMA = "host string, url string, depth int, crawl_delay double, allowed boolean"


def write_batches(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)         # the file source orders files by their second


def run(spark, folder, tmp_dir):
    urls = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).filter("allowed"))
    query = start_schedule_stream(urls, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "chk"), available_now=True)
    query.awaitTermination(300)


def test_replayed_stream_gives_the_batch_schedule(spark, tmp_dir):
    rng = random.Random(5)
    delays = {"a.x": 2.5, "b.x": 0.1, "c.x": 0.0}
    depths = [[(h, f"http://{h}/{d}/{rng.randint(0, 10 ** 9)}", d, delays[h], rng.random() < 0.9)
               for h in rng.choices(list(delays), weights=[5, 2, 1], k=30)] for d in range(4)]
    folder = os.path.join(tmp_dir, "in")
    write_batches(spark, folder, depths[:2])
    run(spark, folder, tmp_dir)
    write_batches(spark, folder, depths[2:])
    run(spark, folder, tmp_dir)                 # from the checkpoint
    columns = ["host", "url", "depth", "slot", F.round("fetch_offset_s", 9)]
    report = spark.createDataFrame([r for rows in depths for r in rows], SCHEMA)
    want = sorted(map(tuple, crawl_schedule(report).select(*columns).collect()))
    got = spark.read.parquet(os.path.join(tmp_dir, "out")).select(*columns).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 60


def test_a_delay_that_changes():
    last, slots, offsets = next_slots(None, [2.0] * 3)
    assert (slots, offsets) == ([1, 2, 3], [0.0, 2.0, 4.0])
    last, slots, offsets = next_slots(last, [5.0, 5.0, 0.0])
    assert (slots, offsets) == ([4, 5, 6], [9.0, 14.0, 14.0])
    assert next_slots(last, [0.0])[1:] == ([7], [14.0])
