"""Shared helpers: the cluster's shared folder, staged tables, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What splits words: space and the five ASCII controls \t \n \v \f \r.
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes and rows of a batch between the JVM and Python. Spark's own bounds, 64 MB and 10,000, are held several times
#: over for each running task, beside the heap.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_USUAL = {"spark.sql.execution.arrow.maxBytesPerBatch": "67108864b", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session, unless it has bounds of its own."""
    for key, value in SMALL_BATCHES.items():
        if spark.conf.get(key, _USUAL[key]) in (_USUAL[key], "67108864", "64m", "64MB"):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in a test, one is
    made here; on a cluster that is an error.
    """
    small_batches(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        named = tempfile.mkdtemp(prefix="duskwire-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/duskwire/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"


#: Whether Spark deletes the shuffles of a query as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    so a lost executor costs a re-read and not a recomputation.

    The shuffles behind it are of no use once it is written. They are deleted with the
    write, and don't stay on disk until the driver happens to collect garbage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged. Results that are not yet written or collected read it, so call it after them."""
    drop_path(spark, _own_dir(spark))


def _drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


#: Rows and bytes up to which a side of a join is broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its rows and the bytes in its texts and arrays, which are counted, allow."""
    held = [F.octet_length(f.name) if f.dataType.typeName() == "string" else F.size(f.name) * 16 for f in df.schema if f.dataType.typeName() in ("string", "array")]
    each = sum((F.coalesce(x, F.lit(0)).cast("long") for x in held), F.lit(32).cast("long"))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged path through Hadoop's file system, whichever store it is in."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text):
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable, for every node of ``edges(a, b)``.

    Alternates large-star and small-star steps; each is a minimum by node (combined
    before the shuffle) and a join back. The minima are written down first: small ones
    are broadcast, so that a hub's edges aren't moved at all, and larger ones are a
    plain scan, so that both sides of the join are dealt out anew and adaptive
    execution splits a hub. Every round is written to the shared folder, and the round
    before it deleted. Self loops and repeated edges are harmless; an empty table
    gives an empty result.

    Returns ``node, component``.
    """
    cur = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _digest(cur)
    for _ in range(max_rounds if before[0] else 0):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lows")
        large = staged(both.where("v > u").join(broadcast_if_small(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        star = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = staged(large.join(broadcast_if_small(least), "u").select(F.explode(star).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "small")
        for old in (cur, low, large, least):
            _drop(old)
        cur = small
        after = _digest(cur)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
