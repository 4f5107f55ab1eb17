"""Findings put together: deduplicated, grouped, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwire.functions.library import truncate

#: Unicode white space, which trimming takes off.
_WHITE = r"[\t\n\x0B\f\r \x85\xA0  -     　]+"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WHITE}|{_WHITE}\z", "")


def dedupe(findings: DataFrame) -> DataFrame:
    """One row per (type, value, source): occurrences and the contexts seen.

    The first context is kept as it is unless blank; each later one is trimmed and
    added if it isn't there yet. Within one text every occurrence of a value has the
    same context, so that gives the context alone, or with its trimmed form if those
    differ and the value occurs twice. Contexts of different texts under one source
    are taken in order of the context. Counts are combined before the shuffle, and
    distinct contexts are all that an aggregate gathers.
    """
    each = findings.groupBy("type", "value", "source_url", "context").agg(F.count("*").alias("n"), F.min("risk").alias("risk"), F.min("description").alias("description"))
    rows = each.groupBy("type", "value", "source_url").agg(
        F.sum("n").cast("int").alias("occurrences"), F.min("risk").alias("risk"), F.min("description").alias("description"), F.array_sort(F.collect_list(F.struct("context", "n"))).alias("seen")
    )
    full = F.filter("seen", lambda s: trim(F.coalesce(s["context"], F.lit(""))) != "")
    head = F.slice(full, 1, 1)
    first = F.transform(head, lambda s: s["context"])
    again = F.flatten(F.transform(full, lambda s, i: F.when((i == 0) & (s["n"] < 2), F.array().cast("array<string>")).otherwise(F.array(trim(s["context"])))))
    return rows.select("type", "risk", "value", "source_url", F.array_distinct(F.concat(first, again)).alias("context"), "occurrences", "description")


def grouped(findings: DataFrame) -> DataFrame:
    """``source_url, findings``: each source with its deduplicated findings, in order of type and value."""
    one = dedupe(findings)
    item = F.struct("type", "value", "risk", "context", "occurrences", "description")
    return one.groupBy("source_url").agg(F.array_sort(F.collect_list(item)).alias("findings"))


def raw_values(findings: DataFrame, by_source: bool = False) -> DataFrame:
    """Deduplicated values; one may recur under another type or source."""
    one = findings.select("type", "value", "source_url").distinct()
    return one.select("source_url", "value") if by_source else one.select("value")


def unique_secrets(findings: DataFrame) -> DataFrame:
    """One finding per type and value: that of the last source, in order of (type, value)."""
    return findings.groupBy("type", "value").agg(F.max(F.struct("source_url", "context", "line")).alias("m")).select("type", "value", "m.source_url", "m.context", "m.line").orderBy("type", "value")


def stable_key(findings: DataFrame) -> DataFrame:
    return findings.withColumn("key", F.concat_ws(":", "source_url", "type", "value"))


def log_groups(findings: DataFrame) -> DataFrame:
    """What a log shows: (type, value, source) with count and the value cut to 35 bytes."""
    return findings.groupBy("type", "value", "source_url").agg(F.count("*").alias("n")).withColumn("shown", truncate(F.col("value"), 35))


def log_lines(findings: DataFrame) -> DataFrame:
    """``type, value, source_url, line``: a log line for each (type, value, source), with the mark of its risk."""
    groups = findings.groupBy("type", "value", "source_url").agg(F.count("*").alias("n"), F.min("risk").alias("risk"))
    mark = F.when(F.col("risk") == "informative", "[INFO-RISK]").when(F.col("risk") == "low", "[LOW]").when(F.col("risk") == "high", "[HIGH]").otherwise("[MEDIUM]")
    times = F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit("x "))).otherwise("")
    line = F.concat(mark, F.lit(" Found "), times, "type", F.lit(": "), truncate(F.col("value"), 35), F.lit("... in "), "source_url")
    return groups.select("type", "value", "source_url", line.alias("line"))


def scan_stats(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: sources, sources with findings, findings, and the bytes of the sources that have some."""
    hit = findings.groupBy("source_url").agg(F.count("*").alias("n"))
    both = docs.select("source_url", F.octet_length("content").cast("long").alias("size")).join(hit, "source_url", "left")
    return both.agg(
        F.count("*").alias("total"), F.count_if(F.col("size").isNotNull()).alias("processed"), F.count_if(F.col("size").isNull()).alias("failed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("secrets"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("size"))), F.lit(0)).alias("total_bytes"),
    )


def content_cache(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings by SHA-256 of the content, in order of type and value."""
    keyed = docs.select("source_url", F.sha2("content", 256).alias("content_hash"))
    return findings.join(keyed, "source_url").groupBy("content_hash").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("type", "value")))).alias("secrets"))


def top(findings: DataFrame, by: str, n: int) -> DataFrame:
    return findings.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def numbered(findings: DataFrame) -> DataFrame:
    """Place of each finding inside its source, in order of type, value and line."""
    return findings.withColumn("nth", F.row_number().over(Window.partitionBy("source_url").orderBy("type", "value", "line")))
