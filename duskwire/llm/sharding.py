"""Contiguous shards of balanced bytes by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwire.llm.common import staged


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut all rows, in id order, into ``n_shards`` contiguous shards of near equal bytes.

    A row's size is its text's UTF-8 bytes (a null text has none) plus 1. Rows are
    range-partitioned on (id, size, CRC), each partition's bytes and rows are
    totalled, and a row's place on the global byte line is its partition's offset
    plus a running sum inside the partition. A row belongs to the shard that holds
    its middle byte when the line is cut at equal targets, so a shard's bytes differ
    from the target by less than the largest row.

    Only (id, size, CRC) is shuffled, never a text; per-partition totals (one short
    row per partition) are all that becomes a broadcast. Null ids come first,
    repeated ids are ordered by size and CRC, an empty table gives no rows, and
    other columns are ignored.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: slot counts
    from 0 inside each shard, in id order; this law has no grown shard (null).
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    order = ["doc_id", "size", "text_crc32"]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    # Range bounds are sampled anew in each run, so the partition of a row is written down once.
    dealt = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "byte_line")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    line = (
        dealt.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), "part")
        .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(middle2 * {n_shards}) div (2 * all_bytes)").cast("int")))
        .withColumn("at", F.col("rows_before") + F.col("nth") - 1)
        .select(*order, "shard", "at")
    )
    firsts = line.groupBy("shard").agg(F.min("at").alias("first_at"))
    return line.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
