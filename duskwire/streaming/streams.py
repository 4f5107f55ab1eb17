"""The scan and the back-off as Structured Streaming queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duskwire.operators.domains import BLOCK_SECONDS, DISCARD_AT, RATE_LIMITED
from duskwire.operators.scan import scan
from duskwire.sources.catalog import Pattern
from duskwire.sources.shared import shared_dir


def read_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Whole text files as they arrive, one row each."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return rows.select(F.col("_metadata.file_path").alias("source_url"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("seen_at"))


def scan_stream(docs: DataFrame, patterns: list[Pattern], dialect: str = "local") -> DataFrame:
    """The scan is map-only, so it runs on a stream as it does on a table."""
    return scan(docs, patterns, dialect)


def count_stream(findings: DataFrame) -> DataFrame:
    """Occurrences by type, value and source, in update mode."""
    return findings.groupBy("type", "value", "source_url").agg(F.count("*").alias("occurrences"))


def first_seen(findings: DataFrame, time_col: str, within: str = "1 hour") -> DataFrame:
    """The first of equal findings that come within a span of event time; state older than that is dropped."""
    return findings.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["type", "value", "source_url"])


STATE = "strikes int, discarded boolean"
EVENTS = "domain string, ts timestamp, action string, until timestamp"


def backoff_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_seconds: int | None = None) -> Iterator[pd.DataFrame]:
    """Block a domain at its first 429, discard it at the next unless a fetch succeeded between."""
    if state.hasTimedOut:
        if not state.get[1]:
            state.remove()
        return
    strikes, discarded = state.get if state.exists else (0, False)
    rows = sorted((ts, int(s)) for b in batches for ts, s in zip(b["ts"], b["status"], strict=True))
    out = []
    for ts, status in rows:
        if discarded:
            break
        if 200 <= status < 300:
            strikes = 0
        elif status == RATE_LIMITED:
            strikes += 1
            discarded = strikes >= DISCARD_AT
            until = None if discarded else ts + timedelta(seconds=BLOCK_SECONDS)
            out.append((key[0], ts, "discard" if discarded else "block", until))
    state.update((strikes, discarded))
    if idle_seconds is not None:
        state.setTimeoutDuration(idle_seconds * 1000)
    yield pd.DataFrame(out, columns=["domain", "ts", "action", "until"]).astype({"until": "datetime64[ns]", "ts": "datetime64[ns]"})


def backoff_stream(fetches: DataFrame, idle_seconds: int | None = None) -> DataFrame:
    """Block and discard actions for a stream of ``domain, ts, status``; two numbers of state a domain.

    A domain that nothing was fetched from for ``idle_seconds`` by the clock loses its
    state, unless it is discarded; None keeps all states. A stream with such a clock
    never runs out of batches: trigger it by time, or see ``run_to_table``.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from backoff_step(key, batches, state, idle_seconds)

    return fetches.groupBy("domain").applyInPandasWithState(step, EVENTS, STATE, "append", timeout)


class Progress(StreamingQueryListener):
    """What streams have read so far: ``rows``, and a line for each trigger through ``show``."""

    def __init__(self, show=print):
        self.rows, self.show = 0, show

    def onQueryStarted(self, event):
        self.show(f"stream {event.name or event.id} started")

    def onQueryProgress(self, event):
        p = event.progress
        self.rows += p.numInputRows
        self.show(f"stream {p.name or p.id}: batch {p.batchId}, {p.numInputRows} rows, {self.rows} so far, {p.processedRowsPerSecond:.0f} a second")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.show(f"stream {event.id} ended")


def start(stream: DataFrame, path: str, every: str | None = None, mode: str = "append"):
    """Start a stream into the folder ``path``: over what there is and then stop, or anew ``every`` so often until stopped."""
    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(**when).start()


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_table(stream: DataFrame, timers: bool = False) -> DataFrame:
    """Run an append stream over what its source holds now, and read back what it wrote.

    Output and progress go to the shared folder, so the run survives lost executors.
    ``timers`` is for a stream whose states time out by the clock: such a stream asks
    for batches without data for ever, so here it gets none.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    was = spark.conf.get(NO_DATA)
    if timers:
        spark.conf.set(NO_DATA, "false")
    try:
        run = start(stream, base)
    finally:
        spark.conf.set(NO_DATA, was)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_counts(stream: DataFrame) -> DataFrame:
    """Run an aggregate stream over what its source holds now; each batch's table replaces the one before."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
