"""Fetching URLs over HTTP, from the tasks that hold them.

URLs are dealt out by host, so that one task keeps a host's rate, and a host's URLs are
fetched in turn. What comes back is a table of responses, which ``inputs.response_content``
turns into texts.
"""

from __future__ import annotations

import random
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwire.operators.buckets import RATE_LIMITED, Bucket
from duskwire.operators.domains import domain_of

RESPONSES = "url string, domain string, status int, content_type string, body string, attempts int, duration_ns long, error string"
#: Seconds of the longest pause between two tries.
LONGEST_PAUSE = 30.0


@dataclass
class Client:
    """How to fetch. ``rate`` is requests a second for each host, 0 for one that adapts; ``pause`` scales all waiting (0 in tests)."""

    timeout: float = 30.0
    retries: int = 3
    rate: float = 0.0
    headers: dict[str, str] = field(default_factory=dict)
    insecure: bool = False
    pause: float = 1.0

    def backoff(self, attempt: int) -> float:
        """1, 2, 4 ... seconds, of which a random half to the whole."""
        return self.pause * min(LONGEST_PAUSE, 2**attempt * (0.5 + 0.5 * random.random()))

    def fetch(self, url: str, bucket: Bucket) -> dict:
        """One response. Only failures of the network are tried again; a 429 empties the host's bucket and ends the fetch."""
        began, out = time.monotonic_ns(), {"url": url, "status": None, "content_type": None, "body": None, "attempts": 0, "error": None}
        context = ssl._create_unverified_context() if self.insecure else None
        for attempt in range(self.retries + 1):
            while not bucket.take(time.monotonic()):
                time.sleep(max(0.01, 1 / bucket.rate))
            out["attempts"] = attempt + 1
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout, context=context) as r:
                    out |= {"status": r.status, "content_type": r.headers.get("Content-Type"), "body": r.read().decode("utf-8", "replace"), "error": None}
                break
            except urllib.error.HTTPError as e:
                out |= {"status": e.code, "error": f"status {e.code}"}
                if e.code == RATE_LIMITED:
                    bucket.limited(time.monotonic())
                break
            except (OSError, ValueError) as e:  # refused, reset, timed out, no such host, a URL of no known kind
                out["error"] = str(e) or type(e).__name__
                if isinstance(e, ValueError) or attempt == self.retries:
                    break
                time.sleep(self.backoff(attempt))
        return out | {"duration_ns": time.monotonic_ns() - began}


def fetch(urls: DataFrame, client: Client | None = None, tasks: int | None = None) -> DataFrame:
    """``url, domain, status, content_type, body, attempts, duration_ns, error`` for every row of ``urls(url)``.

    A URL without a host fails with an error and no status; repeated URLs are fetched
    again. A task that is lost fetches its URLs anew, so write the result down before
    it is used more than once.
    """
    client = client or Client()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets: dict[str, Bucket] = {}
        for b in batches:
            rows = []
            for url, domain in zip(b["url"], b["domain"], strict=True):
                if not isinstance(domain, str):
                    rows.append({"url": url, "domain": None, "attempts": 0, "duration_ns": 0, "error": "no host"})
                    continue
                bucket = buckets.setdefault(domain, Bucket.new(client.rate, time.monotonic()))
                rows.append(client.fetch(url, bucket) | {"domain": domain})
            names = [x.split()[0] for x in RESPONSES.split(", ")]
            made = pd.DataFrame(rows, columns=names)
            yield made.astype({"status": "Int32", "attempts": "int32", "duration_ns": "int64"})

    rows = urls.select("url", domain_of(F.col("url")).alias("domain"))
    dealt = rows.repartition(tasks, "domain") if tasks else rows.repartition("domain")
    return dealt.mapInPandas(run, RESPONSES)
