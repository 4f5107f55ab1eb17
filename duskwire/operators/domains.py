"""URLs by domain: extraction, fair queues, fetch figures, and back-off after HTTP 429."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwire.sources.shared import numbered_in_order, staged

RATE_LIMITED, DISCARD_AT = 429, 2
BLOCK_SECONDS, FIXED_BLOCK_SECONDS = 10, 5


def domain_of(url: Column) -> Column:
    """Host without user and port, in the case it is written in; null without a host."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1)
    host = F.regexp_replace(authority, r":[^:]*\z", "")
    return F.when(host != "", host)


def is_valid_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")), F.lit(False))


def by_domain(urls: DataFrame) -> DataFrame:
    """``domain, n``: URLs of each domain. Those without a host are left out."""
    return urls.withColumn("domain", domain_of(F.col("url"))).where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"))


def round_robin(urls: DataFrame, position: str = "input_pos") -> DataFrame:
    """A fair queue: one URL of each domain in turn, domains with most URLs first, ties by name.

    Both the round (a URL's place inside its domain) and the place in the queue come
    from places in a global order over ranges of rows, so that neither a domain nor a
    round meets in one task. What a domain has is an aggregate, written down before the
    rows are joined to it, so that adaptive execution can split a domain of many URLs.
    """
    rows = urls.select("url", position, domain_of(F.col("url")).alias("domain")).where("domain is not null")
    placed = staged(numbered_in_order(rows, ["domain", position, "url"], "_at"), "placed")
    sizes = staged(placed.groupBy("domain").agg(F.count("*").alias("_urls"), F.min("_at").alias("_first")), "domain_sizes")
    rounds = placed.join(sizes, "domain").select("url", "domain", "_urls", (F.col("_at") - F.col("_first") + 1).cast("int").alias("round"))
    queue = numbered_in_order(rounds, ["round", F.desc("_urls"), "domain"], "_at")
    return queue.select("url", "domain", "round", (F.col("_at") + 1).alias("queue_pos"))


def top_domains(urls: DataFrame, n: int) -> DataFrame:
    return by_domain(urls).orderBy(F.desc("n"), "domain").limit(n)


def status_summary(fetches: DataFrame) -> DataFrame:
    """``status, n, rank``: counts by code; 429, 403, 404, 500, 502, 503, 504 first, then the others by code."""
    first = [429, 403, 404, 500, 502, 503, 504]
    known = F.array_position(F.array(*[F.lit(c) for c in first]), F.col("status"))
    counts = fetches.where("status > 0").groupBy("status").agg(F.count("*").alias("n"))
    key = F.when(known > 0, known).otherwise(F.lit(len(first) + 1))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(key, "status")))


def status_text(fetches: DataFrame) -> str:
    parts = [f"{r.status}={r.n}" for r in status_summary(fetches).orderBy("rank").collect()]
    return ", ".join(parts) or "none"


def domain_stats(fetches: DataFrame) -> DataFrame:
    ok = F.col("status").between(200, 299)
    return fetches.groupBy("domain").agg(F.count("*").alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(F.col("status") == RATE_LIMITED).alias("rate_limited"), F.max("ts").alias("last_access"))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of domain and time; a domain's state is two numbers, whatever its rows."""
    now, average, n = None, 0, 0
    for b in batches:
        out = []
        for domain, ns in zip(b["domain"], b["duration_ns"], strict=True):
            if domain != now:
                if n:
                    out.append((now, average, n))
                now, average, n = domain, 0, 0
            average = int(ns) if average == 0 else (average * 3 + int(ns)) // 4
            n += 1
        yield pd.DataFrame(out, columns=["domain", "average_ns", "n"])
    yield pd.DataFrame([(now, average, n)] if n else [], columns=["domain", "average_ns", "n"])


def ewma_latency(fetches: DataFrame) -> DataFrame:
    """``domain, average_ns, n``: moving average of successful fetches, (3 a + x) div 4 in order of time, the first seeding it.

    The step rounds down, so it can't be combined from parts; rows are ordered by a
    sort that spills, and folded as they stream by.
    """
    rows = fetches.where(F.col("status").between(200, 299) & F.col("domain").isNotNull()).select("domain", "ts", "duration_ns")
    dealt = rows.repartition("domain").sortWithinPartitions("domain", "ts", "duration_ns").select("domain", "duration_ns")
    return dealt.mapInPandas(_fold, "domain string, average_ns long, n long")


def backoff(fetches: DataFrame, adaptive: bool = True) -> DataFrame:
    """What rate limiting does to each domain.

    A first 429 blocks the domain for a while; a second one without a success between
    discards it, and nothing after that counts. Other failures change nothing.

    Returns ``domain, blocks, discarded, discarded_at, last_blocked_until``.
    """
    turn = fetches.where((F.col("status") == RATE_LIMITED) | F.col("status").between(200, 299))
    order = Window.partitionBy("domain").orderBy("ts", "seq")
    marked = turn.withColumn("again", (F.col("status") == RATE_LIMITED) & (F.lag("status").over(order) == RATE_LIMITED))
    ends = marked.groupBy("domain").agg(F.min(F.when(F.col("again"), F.struct("ts", "seq"))).alias("end"))
    both = marked.join(ends, "domain")
    live = F.col("end").isNull() | (F.struct("ts", "seq") < F.col("end"))
    block = (F.col("status") == RATE_LIMITED) & live
    wait = F.expr(f"INTERVAL {BLOCK_SECONDS if adaptive else FIXED_BLOCK_SECONDS} SECONDS")
    return both.groupBy("domain").agg(
        F.count_if(block).alias("blocks"), F.max(F.col("end").isNotNull()).alias("discarded"), F.max("end.ts").alias("discarded_at"), F.max(F.when(block, F.col("ts") + wait)).alias("last_blocked_until")
    )


def open_queue(queue: DataFrame, blocks: DataFrame, now: Column) -> DataFrame:
    """Queued URLs whose domain is neither discarded nor blocked at ``now``."""
    shut = blocks.where(F.col("discarded") | (F.col("last_blocked_until") > now)).select("domain")
    return queue.join(shut, "domain", "left_anti")
