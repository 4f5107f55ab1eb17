"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session names none, as in a test on one machine, one is made. On a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        named = tempfile.mkdtemp(prefix="duskwire-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/duskwire/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_in_order(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with column ``name``: each row's place, from 0, in a global order.

    Rows are dealt out by ranges of the order; a place is the rows of the ranges before,
    of which one short row each tells, and a row number inside the range.
    """
    # Range bounds are sampled anew in each run, so the range of a row is written down once.
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + nth - 1).drop("_range", "_before")
