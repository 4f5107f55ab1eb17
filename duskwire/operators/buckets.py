"""Token buckets: which requests of a domain a rate lets through, in a batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Requests a second at first, at least and at most, and how the rate follows errors.
START_RATE, LEAST_RATE, MOST_RATE = 15.0, 3.0, 40.0
LOWER, RAISE = 0.7, 1.2
QUIET_SECONDS, RECOVERED_SECONDS = 30.0, 120.0
RATE_LIMITED = 429


@dataclass
class Bucket:
    """Tokens of one domain. ``fixed`` is a rate that never changes, or 0 for one that adapts. Times are seconds."""

    fixed: float = 0.0
    rate: float = 0.0
    tokens: float = 0.0
    filled_at: float = 0.0
    error_at: float = -1.0

    @classmethod
    def new(cls, fixed: float, now: float) -> Bucket:
        rate = fixed or START_RATE
        return cls(fixed, rate, rate, now)

    def refill(self, now: float) -> None:
        gone = now - self.filled_at
        if gone <= 0:
            return
        quiet = now - self.error_at
        if self.error_at >= 0 and quiet > QUIET_SECONDS:
            if quiet > RECOVERED_SECONDS:
                self.rate = min(MOST_RATE, self.rate * RAISE * 2)
                if self.rate >= MOST_RATE:
                    self.error_at = -1.0
            else:
                self.rate = min(MOST_RATE, self.rate + self.rate * (RAISE - 1) * (gone / RECOVERED_SECONDS))
        self.tokens = min(self.rate, self.tokens + gone * self.rate)
        self.filled_at = now

    def take(self, now: float) -> bool:
        self.refill(now)
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True

    def limited(self, now: float) -> None:
        """The server answered 429: an adapting rate falls, and its bucket is empty."""
        if not self.fixed:
            self.rate = max(LEAST_RATE, self.rate * LOWER)
            self.error_at, self.tokens = now, 0.0


ALLOWED = "domain string, ts timestamp, seq long, allowed boolean, rate double"


def _serve(bucket: Bucket, now: float, status: int) -> tuple[bool, float]:
    went = bucket.take(now)
    if went and status == RATE_LIMITED:
        bucket.limited(now)
    return went, bucket.rate


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def allowed(requests: DataFrame, rate: float = 0.0) -> DataFrame:
    """``domain, ts, seq, allowed, rate``: whether each request of ``domain, ts, seq, status`` finds a token, and the rate then.

    A request that does gets its ``status``; a 429 lowers an adapting rate. Each step
    depends on the one before it, so the requests of a domain stream past its bucket in
    order of time, after a sort that spills; a task holds one bucket. Null domains take
    no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bucket = None, Bucket()
        for b in batches:
            out = []
            for domain, t, status in zip(b["domain"], _seconds(b["ts"]), b["status"], strict=True):
                if domain != now:
                    now, bucket = domain, Bucket.new(rate, t)
                out.append(_serve(bucket, t, status))
            made = b[["domain", "ts", "seq"]].copy()
            made["allowed"], made["rate"] = [x for x, _ in out], [x for _, x in out]
            yield made

    rows = requests.where("domain is not null").selectExpr("domain", "ts", "cast(seq as long) seq", "coalesce(cast(status as int), 0) status")
    return rows.repartition("domain").sortWithinPartitions("domain", "ts", "seq").mapInPandas(run, ALLOWED)


STATE = "fixed double, rate double, tokens double, filled_at double, error_at double"


def allowed_stream(requests: DataFrame, rate: float = 0.0, idle_seconds: int = 600) -> DataFrame:
    """The same on a stream; a domain without requests for ``idle_seconds`` loses its state and starts anew."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        times = _seconds(rows["ts"])
        bucket = Bucket(*state.get) if state.exists else Bucket.new(rate, times[0])
        out = [_serve(bucket, t, s) for t, s in zip(times, rows["status"], strict=True)]
        made = rows[["domain", "ts", "seq"]].copy()
        made["allowed"], made["rate"] = [x for x, _ in out], [x for _, x in out]
        state.update((bucket.fixed, bucket.rate, bucket.tokens, bucket.filled_at, bucket.error_at))
        state.setTimeoutDuration(idle_seconds * 1000)
        yield made

    rows = requests.where("domain is not null").selectExpr("domain", "ts", "cast(seq as long) seq", "coalesce(cast(status as int), 0) status")
    return rows.groupBy("domain").applyInPandasWithState(step, ALLOWED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
