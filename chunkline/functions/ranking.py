"""Ranks and indexes without a window over a whole table or a huge bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkline.sources.storage import staged


def hash_rank(df: DataFrame, bucket: list[str], hashed: Column, *ties: str) -> DataFrame:
    """Adds ``rank`` (1..n) and ``bucket_n`` in each bucket, by a hex digest and then ``ties``.

    A bucket is cut by the first two digits of the digest: a window holds a 256th of it, and counts of the
    parts give their offsets.
    """
    d = df.withColumn("_h", hashed).withColumn("_p", F.substring("_h", 1, 2))
    parts = d.groupBy(*bucket, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*bucket).orderBy("_p")
    offsets = parts.select(
        *[F.col(b).alias(f"_b{i}") for i, b in enumerate(bucket)], F.col("_p").alias("_q"),
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*bucket)).alias("bucket_n"),
    )
    same = F.col("_p") == F.col("_q")
    for i, b in enumerate(bucket):
        same &= F.col(b).eqNullSafe(F.col(f"_b{i}"))
    inner = Window.partitionBy(*bucket, "_p").orderBy("_h", *ties)
    d = d.withColumn("_r", F.row_number().over(inner)).join(offsets, same)
    return d.withColumn("rank", F.col("_r") + F.col("_before")).drop("_h", "_p", "_q", "_r", "_before", *[f"_b{i}" for i in range(len(bucket))])


def dense_index(df: DataFrame, *keys: str, name: str = "idx") -> DataFrame:
    """Adds 0..n-1 in the order of ``keys`` (which should tell rows apart): ranges, their counts, and ranks within."""
    dealt = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    inner = Window.partitionBy("_part").orderBy(*keys)
    # one row for each partition
    return dealt.withColumn("_r", F.row_number().over(inner)).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_r") - 1 + F.col("_before")).drop("_part", "_r", "_before")
