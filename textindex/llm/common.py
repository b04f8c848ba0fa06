"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textindex.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` (all executors see the files, so a
    lost executor costs a re-read), but columnar and compressed.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks of about ``per_block`` rows ``rows`` rows make."""
    return max(1, -(-rows // per_block))


def block_of(key: Column, blocks: int) -> Column:
    """A block number 0..blocks-1 for a row key (null keys share one block)."""
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


#: Broadcast a side only if its counted rows take at most this much.
BROADCAST_BYTES = 8 << 20


def number_within(df: DataFrame, key: str, order: list[str], out: str = "n") -> DataFrame:
    """``df`` with ``out``, a row's number within its ``key`` by ``order``, from 0.

    Rows are dealt by range of (key, order), so a hot key is spread over many
    tasks, which number their own rows; the counts of each key in each task, a
    row each, give the offsets.
    """
    dealt = [key, *[c for c in order if c != key]]
    local = materialize(
        df.repartitionByRange(*[F.col(c) for c in dealt]).sortWithinPartitions(*dealt)
        .select("*", F.spark_partition_id().alias("_task"),
                F.monotonically_increasing_id().alias("_at")), "numbering")
    held = materialize(local.groupBy(key, "_task").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "numbering-counts")
    before = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(F.col(key).alias("_key"), F.col("_task").alias("_in"),
                          (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    if held.count() * 64 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    return (local.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_task") == F.col("_in")))
            .withColumn(out, F.col("_at") + F.col("_off"))
            .drop("_task", "_at", "_key", "_in", "_off"))
