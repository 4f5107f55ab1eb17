from __future__ import annotations

import time

from pyspark.sql import functions as F

from duskwire.llm import common


def shuffles(spark):
    """Files of shuffles that this machine holds."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in str(files.mkString("\n")).split("\n") if "/shuffle_" in f}


def test_staging_leaves_no_shuffle(spark):
    usual = spark.conf.get(common.CLEANUP)
    before = shuffles(spark)
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "count")
    kept = common.staged(df, "counts")
    until = time.time() + 10
    while (left := shuffles(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(common.CLEANUP) == usual
    assert df.count() == kept.count() == 100 and kept.agg(F.sum("count")).first()[0] == 10_000
