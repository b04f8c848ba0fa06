"""The distributed per-key row number equals a window row_number, also when one key is huge."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textindex.operators.ranking import row_number_within


def test_matches_window_on_skewed_key(spark):
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"),
        (F.col("id") * 7919 % 5000).alias("ord"))
    got = row_number_within(df, "key", ["ord"], num_partitions=7)
    w = Window.partitionBy("key").orderBy("ord")
    want = df.withColumn("rn", F.row_number().over(w))
    assert got.select("key", "ord", "rn").exceptAll(want).count() == 0
    assert want.exceptAll(got.select("key", "ord", "rn")).count() == 0
