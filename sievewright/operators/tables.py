"""Tables written between steps, and positions in an order that no single task has to hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all nodes share, which the cluster names in ``spark.checkpoint.dir``.

    A session on this machine alone may leave that unset and gets a temporary folder; a cluster may not.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievewright-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/sievewright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The table written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_before(rows: DataFrame, group: str | None, order: list[Column], flag: Column, name: str) -> DataFrame:
    """Adds ``name``: how many rows before each, within its group and in this order, have the flag.

    Rows are dealt by ranges of group and order; a range's own count and those of the ranges before it, a
    row per range and group, give the position. So neither a group nor the whole table is one task's.
    Finding the ranges reads ``rows`` once more: what is dear to compute should be written before.
    """
    own = [F.col(group)] if group else []
    dealt = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("int")).repartitionByRange(*own, *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    keys = [group, "_range"] if group else ["_range"]
    sums = dealt.groupBy(*keys).agg(F.sum("_flag").alias("_n"))
    before = Window.partitionBy(*([group] if group else [])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    if group:
        sums = sums.withColumnRenamed(group, "_group")
        dealt = dealt.join(sums.withColumnRenamed("_range", "_r"), (F.col(group).eqNullSafe(F.col("_group"))) & (F.col("_range") == F.col("_r"))).drop("_group", "_r")
    else:
        dealt = dealt.join(sums, "_range")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(name, F.col("_base") + F.coalesce(F.sum("_flag").over(inside), F.lit(0))).drop("_flag", "_range", "_base")


def spread_join(rows: DataFrame, few: DataFrame, on: str, by: str, copies: int = 32) -> DataFrame:
    """Rows with the columns of ``few``, which has a row per key ``on``: each key's rows are dealt by ``by`` over
    copies of that row, so that a key of a third of all rows is many tasks'."""
    copied = few.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.withColumn("_copy", F.pmod(F.xxhash64(by), F.lit(copies)).cast("int")).join(copied, [on, "_copy"]).drop("_copy")
