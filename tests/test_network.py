"""Fetching, rate limits, settings, progress and files."""

from __future__ import annotations

import random
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from duskwire.operators import buckets
from duskwire.operators.domains import round_robin
from duskwire.sources import config, files, http, inputs
from duskwire.streaming import streams


class Answers(BaseHTTPRequestHandler):
    asked: list[tuple[str, str | None]] = []

    def do_GET(self):
        Answers.asked.append((self.path, self.headers.get("X-Test")))
        status = {"/missing": 404, "/slow": 429}.get(self.path, 200)
        body = f"body of {self.path}".encode()
        self.send_response(status)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetching(spark, site):
    client = http.Client(timeout=5, retries=2, headers={"X-Test": "yes"}, pause=0)
    urls = [f"{site}/a.js", f"{site}/missing", f"{site}/slow", "http://127.0.0.1:9/refused", "no host", f"{site}/b"]
    rows = {r.url: r for r in http.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), client).collect()}
    assert rows.keys() == set(urls)
    ok = rows[urls[0]]
    assert (ok.status, ok.body, ok.attempts, ok.error, ok.domain) == (200, "body of /a.js", 1, None, "127.0.0.1") and ok.content_type.startswith("text/html") and ok.duration_ns > 0
    assert (rows[urls[1]].status, rows[urls[1]].attempts, rows[urls[1]].body) == (404, 1, None)
    assert (rows[urls[2]].status, rows[urls[2]].attempts) == (429, 1)
    refused = rows[urls[3]]
    assert refused.status is None and refused.attempts == 3 and refused.error
    assert rows["no host"].error == "no host" and rows["no host"].attempts == 0
    assert ("/a.js", "yes") in Answers.asked
    texts = inputs.response_content(http.fetch(spark.createDataFrame([(urls[0],), (urls[1],)], "url string"), client)).collect()
    assert [(r.source_url, r.content) for r in texts] == [(urls[0], "body of /a.js")]


def test_backoff_doubles_up_to_a_bound():
    client = http.Client()
    for k, whole in enumerate([1, 2, 4, 8, 16, 30, 30]):
        assert all(min(30, 0.5 * 2**k) <= client.backoff(k) <= whole for _ in range(20))


def plain_bucket(requests, fixed):
    """Requests of one domain as (seconds, status), by the rules one after the other."""
    rate = tokens = fixed or 15.0
    last, error, out = requests[0][0], None, []
    for t, status in requests:
        gone = t - last
        if gone > 0:
            if error is not None and t - error > 30:
                if t - error > 120:
                    rate = min(40.0, rate * 1.2 * 2)
                    error = None if rate >= 40 else error
                else:
                    rate = min(40.0, rate + rate * (1.2 - 1) * (gone / 120))
            tokens = min(rate, tokens + gone * rate)
            last = t
        went = tokens >= 1
        if went:
            tokens -= 1
            if status == 429 and not fixed:
                rate, error, tokens = max(3.0, rate * 0.7), t, 0.0
        out.append((went, rate))
    return out


@pytest.mark.parametrize("fixed", [0.0, 2.0])
def test_buckets_against_brute_force_and_as_a_stream(spark, tmp_path, fixed):
    rng = random.Random(3)
    start, rows = datetime(2024, 1, 1), []
    for host in range(3):
        t = 0.0
        for k in range(400):
            t += rng.choice([0.01, 0.05, 0.2, 1.0, 40.0, 200.0] if k % 40 == 0 else [0.01, 0.05, 0.1])
            rows.append((f"h{host}", start + timedelta(microseconds=round(t * 1e6)), k, 429 if rng.random() < 0.03 else 200))
    rows += [(None, start, 1, 200)]
    df = spark.createDataFrame(rows, "domain string, ts timestamp, seq long, status int")
    have = {(r.domain, r.seq): (r.allowed, r.rate) for r in buckets.allowed(df, fixed).collect()}
    for host in range(3):
        own = [((ts - start).total_seconds() + 1_704_067_200, s) for d, ts, _, s in rows if d == f"h{host}"]
        want = plain_bucket(own, fixed)
        assert [have[f"h{host}", k][0] for k in range(400)] == [w for w, _ in want]
        assert [have[f"h{host}", k][1] for k in range(400)] == pytest.approx([r for _, r in want])
    assert len({x for x, _ in have.values()}) == 2
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = buckets.allowed_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), fixed)
    assert {(r.domain, r.seq): (r.allowed, r.rate) for r in streams.run_to_table(stream, timers=True).collect()} == have


def test_states_that_time_out_give_the_same_actions(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 0, 0, k), 429 if k in (1, 5, 6, 8) else 200) for k in range(10)] + [("b", datetime(2024, 1, 1), 429)]
    df = spark.createDataFrame(rows, "domain string, ts timestamp, status int").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    made = lambda idle: streams.backoff_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), idle)
    plain = sorted(map(tuple, streams.run_to_table(made(None)).collect()), key=str)
    assert [(r[0], r[2]) for r in plain] == [("a", "block"), ("a", "block"), ("a", "discard"), ("b", "block")]
    assert sorted(map(tuple, streams.run_to_table(made(600), timers=True).collect()), key=str) == plain


def test_settings(tmp_path):
    path = str(tmp_path / "deep" / "settings.yaml")
    assert config.load(path) == config.Settings()
    config.save(config.Settings(timeout=5, regex_file="x.yaml"), path)
    assert config.load(path) == config.Settings(timeout=5, regex_file="x.yaml")
    (tmp_path / "odd.yaml").write_text("timeout: 7\nunknown: 1\nverbose:\n")
    assert config.load(str(tmp_path / "odd.yaml")) == config.Settings(timeout=7)


def test_progress(spark, tmp_path):
    spark.range(25).write.parquet(str(tmp_path / "in"))
    lines: list[str] = []
    listener = streams.Progress(lines.append)
    spark.streams.addListener(listener)
    try:
        assert streams.run_to_table(spark.readStream.schema("id long").parquet(str(tmp_path / "in"))).count() == 25
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.rows == 25 and any("25 rows" in x for x in lines)


def test_files(spark, tmp_path):
    at = str(tmp_path / "a" / "b.txt")
    assert not files.file_exists(spark, at) and files.file_info(spark, at) is None and not files.is_readable(spark, at)
    files.make_folder(spark, str(tmp_path / "a"))
    (tmp_path / "a" / "b.txt").write_text("hello")
    assert files.folder_exists(spark, str(tmp_path / "a")) and not files.file_exists(spark, str(tmp_path / "a"))
    assert files.file_size(spark, at) == 5 and files.is_readable(spark, at) and files.file_exists(spark, at)
    with pytest.raises(FileNotFoundError):
        files.file_size(spark, str(tmp_path / "none"))
    assert files.temporary_name("x", ".log") != files.temporary_name("x", ".log")


def test_overlapping_inputs_are_read_once_without_a_shuffle(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(4):
        (tmp_path / "d" / f"{k}.txt").write_text(f"text {k}")
    rows = inputs.read_files(spark, [str(tmp_path / "d"), str(tmp_path / "d" / "1.txt"), f"{tmp_path}/d/*.txt", str(tmp_path)])
    assert sorted(r.content for r in rows.collect()) == [f"text {k}" for k in range(4)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    flat = inputs.read_files(spark, [str(tmp_path / "d"), str(tmp_path / "d" / "1.txt")], recursive=False)
    assert flat.count() == 4


def test_a_domain_with_most_urls(spark):
    urls = [(k, f"http://{'hot' if k % 10 else f'h{k % 7}'}.test/{k}") for k in range(2000)]
    rows = round_robin(spark.createDataFrame(urls, "input_pos long, url string")).orderBy("queue_pos").collect()
    assert [r.queue_pos for r in rows] == list(range(1, 2001))
    seen: dict[str, int] = {}
    for r in rows:
        seen[r.domain] = seen.get(r.domain, 0) + 1
        assert r.round == seen[r.domain]
    assert [(r.round) for r in rows] == sorted(r.round for r in rows)
    plan = round_robin(spark.createDataFrame(urls, "input_pos long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(domain" not in plan and "hashpartitioning(round" not in plan


def test_log_values_are_cut_by_bytes(spark):
    from duskwire.operators.findings import log_groups

    rows = spark.createDataFrame([("t", "é" * 20, "s"), ("t", "x" * 35, "s")], "type string, value string, source_url string")
    shown = {r.value[0]: r.shown for r in log_groups(rows).collect()}
    assert shown == {"é": "é" * 16 + "...", "x": "x" * 35}
    assert rows.where(F.octet_length("value") == 40).count() == 1
