"""Benchmark decontamination: short test items found inside long documents.

Containment search by MinHash: test items are partitioned by size, and every item of
a size class keeps a bottom-k MinHash sketch, the k of its shingles with the smallest
hashes, with k set by the class's largest size. A document that contains a share
``threshold`` of an item lacks at most ``(1 - threshold) * size`` of its shingles,
which is fewer than k, so at least one sketched shingle is in the document and no
contained item is missed. Documents are not sketched: beside a long document a short
item changes no signature, so they probe the sketches with each of their shingles.
Candidates are then verified by exact containment, on the shingles' texts.

Everything is DataFrame expressions; shingle hashes are made and looked up inside
whole-stage code, and no text is shuffled while the sketches or the candidates can
be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwire.llm.common import broadcast_if_small, staged

SHINGLE, THRESHOLD = 5, 0.8
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def words(text):
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")


def _at(i: int):
    return F.get("words", F.col("i") + i)


def _shingles(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (with ``words``) times the places ``i`` where a shingle of ``width`` words begins."""
    long_enough = rows.where(F.size("words") >= width)
    return long_enough.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - width)))


def _hash(width: int):
    return F.xxhash64(*[_at(k) for k in range(width)])


def _text(width: int):
    return F.concat_ws(" ", *[_at(k) for k in range(width)])


def item_shingles(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``item_id, width, h, shingle, n``: an item's distinct shingles; an item of fewer words is one shingle."""
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).where("size(words) > 0")
    made = None
    for w in range(1, width + 1):
        own = rows.where(F.size("words") >= w) if w == width else rows.where(F.size("words") == w)
        part = _shingles(own, w).select("item_id", F.lit(w).alias("width"), _hash(w).alias("h"), _text(w).alias("shingle"))
        made = part if made is None else made.unionByName(part)
    made = made.distinct()
    sizes = made.groupBy("item_id").agg(F.count("*").alias("n"))
    return made.join(sizes, "item_id")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """The bottom-k sketch of each item; k grows with the size class, a power of two."""
    from pyspark.sql import Window

    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    k = F.floor(upper * F.lit(1 - threshold) + F.lit(1e-9)) + 1
    order = Window.partitionBy("item_id").orderBy("h", "shingle")
    return shingles.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("item_id", "width", "h")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    width: int = SHINGLE,
) -> DataFrame:
    """Pairs of a document and a test item whose shingles it holds to a share of ``threshold`` or more.

    Shingles are ``width`` words (runs of letters and digits, lower-cased) of the
    whole text; an item of fewer words is one shingle of its own length; an item or a
    text that is null or without words pairs with nothing. Items of equal text pair
    each; a repeated item id or document row gives its pair once, with the most that
    a row of that id holds; null ids are ids of their own; other columns are ignored;
    an empty table on either side gives no rows.

    Returns ``doc_id, item_id, n_shingles, n_found, containment``.
    """
    named = items.select(F.xxhash64(item_text_col).alias("copy"), F.col(item_id_col), F.col(item_text_col))
    shingles = staged(item_shingles(named.withColumn("both", F.struct(item_id_col, "copy")), "both", item_text_col, width), "item_shingles")
    sketch = broadcast_if_small(sketches(shingles, threshold))
    used = sorted(r["width"] for r in shingles.select("width").distinct().collect())
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy")).alias("doc"), words(F.col(text_col)).alias("words"))
    hits = None
    for w in used:
        probe = _shingles(rows, w).select("doc", _hash(w).alias("h"))
        part = probe.join(sketch.where(F.col("width") == w) if len(used) > 1 else sketch, "h").select("doc", "item_id")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = rows.select("doc").crossJoin(shingles.select("item_id")).limit(0)
    found = staged(hits.distinct(), "candidates")
    kept = rows.join(broadcast_if_small(found.select("doc").distinct()), "doc", "left_semi")
    full = None
    index = broadcast_if_small(shingles.select("item_id", "width", "shingle", "n"))
    for w in used:
        held = _shingles(kept, w).select("doc", F.lit(w).alias("width"), _text(w).alias("shingle"))
        part = held.join(index, ["width", "shingle"]).select("doc", "item_id", "shingle", "n")
        full = part if full is None else full.unionByName(part)
    if full is None:
        full = found.select("doc", "item_id", F.lit("").alias("shingle"), F.lit(1).cast("long").alias("n"))
    share = full.distinct().groupBy("doc", "item_id").agg(F.count("*").alias("n_found"), F.first("n").alias("n"))
    sure = share.join(found, ["doc", "item_id"], "left_semi").where(F.col("n_found") >= F.lit(threshold) * F.col("n") - 1e-9)
    best = sure.groupBy(F.col("doc.doc_id").alias("doc_id"), F.col(f"item_id.{item_id_col}").alias("item_id"))
    top = best.agg(F.max(F.struct((F.col("n_found") / F.col("n")).alias("c"), "n_found", "n")).alias("m"))
    return top.select("doc_id", "item_id", F.col("m.n").alias("n_shingles"), F.col("m.n_found").alias("n_found"), F.col("m.c").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold a test item; columns and other rows, null ids included, stay as they are."""
    bad = staged(contained_items(docs, items, id_col, text_col, **options).select("doc_id").distinct(), "leaks")
    return docs.join(broadcast_if_small(bad), docs[id_col].eqNullSafe(bad.doc_id), "left_anti")
