"""Row numbers within a key that stay distributed when one key is huge.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` puts a whole key in one
task. Here the rows are range-partitioned on ``(key, order...)`` instead, so a
hot key is split over many tasks; each task numbers its rows locally, and a
small per-(key, task) count table supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_number_within(df: DataFrame, key: str, order: Sequence[str], out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row within its ``key`` by ``order``.

    ``order`` must make rows unique within a key. The numbered intermediate is
    written with a reliable ``checkpoint()`` (shared checkpoint folder), so task
    ids and local numbers cannot change between its two uses.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [key, *order]
    local = (df.repartitionByRange(n, *[F.col(c) for c in cols])
             .sortWithinPartitions(*cols)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    local = local.checkpoint(eager=True)
    # One row per (key, task): how many rows of the key each task holds, and
    # where in the task they start.
    per_task = (local.groupBy(key, "_pid")
                .agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first")))
    w = (Window.partitionBy(key).orderBy("_pid")
         .rowsBetween(Window.unboundedPreceding, -1))
    per_task = per_task.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return (local.join(per_task.select(key, "_pid", "_first", "_before"), [key, "_pid"])
            .withColumn(out, (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_mid", "_first", "_before"))
