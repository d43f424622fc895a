"""Row numbers in a global order without a single-partition window.

``row_number() over (order by k)`` with no partition clause moves every row
into one task. Here the rows are range-partitioned by ``k`` (one shuffle,
many tasks) and checkpointed, so the numbering pass and the size pass see
the same range bounds. Each partition numbers its own rows; one row per
partition (its size) is turned into offsets and broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.session import checkpoint_root


def global_row_number(df: DataFrame, order: list[Column], name: str = "n",
                      num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_root(spark)
    n = num_partitions or spark.sparkContext.defaultParallelism
    ranged = (df.repartitionByRange(n, *order)
              .withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    local = ranged.withColumn("_local", F.row_number().over(
        Window.partitionBy("_pid").orderBy(*order)))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    # At most ``n`` rows: one per range partition.
    offsets = sizes.select("_pid", F.sum("_size").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local")).cast("long"))
            .drop("_pid", "_local", "_off"))
