"""Continuous indexing of a directory with Structured Streaming.

The source ``textindex.sources.tree`` reads new and changed ``.txt``/``.md`` files, at
most ``max_files_per_trigger`` per micro-batch (the reference flushes every 100
documents), on a processing-time trigger (every 5 s in the reference). A run over
what exists takes all of it in one micro-batch, as Spark fixes its end when it starts.
The list of files already read is kept beside the checkpoint. Each micro-batch updates
the store: only the buckets of its documents are rewritten, and
a batch that is replayed is known by its number and writes nothing. The checkpoint
location must be on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textindex.plans.store import IndexStore
from textindex.sources import tree
from textindex.sources.files import file_documents

BATCH_FILES = 100
TRIGGER_INTERVAL = "5 seconds"


def file_stream(spark: SparkSession, root: str, log_location: str,
                max_files_per_trigger: int = BATCH_FILES) -> DataFrame:
    """Files as they come; ``log_location`` is the stream's own folder on shared storage."""
    tree.register(spark)
    return (spark.readStream.format(tree.FORMAT)
            .option("logLocation", log_location)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .load(root))


def start_indexing_stream(spark: SparkSession, input_root: str, store_root: str,
                          checkpoint_location: str, available_now: bool = False,
                          max_files_per_trigger: int = BATCH_FILES,
                          trigger_interval: str = TRIGGER_INTERVAL, **analyze_kwargs) -> StreamingQuery:
    """Start the stream; ``available_now=True`` processes what exists and stops."""
    store = IndexStore(spark, store_root)

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        store.update(file_documents(batch), batch=f"{checkpoint_location}#{batch_id}", **analyze_kwargs)

    files = file_stream(spark, input_root, f"{checkpoint_location.rstrip('/')}/files",
                        0 if available_now else max_files_per_trigger)
    writer = (files.writeStream
              .foreachBatch(index_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=trigger_interval))
    return writer.start()
