"""Registered queries of inputs, catalog selection, reports, streams and rate limits, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwire.operators import buckets, findings
from duskwire.plans import queries as E
from duskwire.plans import reference_sql as S
from duskwire.sources import catalog, inputs, sinks
from duskwire.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# ---- inputs

_MARKS = ["{", "}", "function", "var ", "let ", "const ", "import ", "export ", "class ", "if ", "for ", "while ", "switch ", "<html", "<div", "<script", "/*", "*/", "//", "#include", "#define", "package "]
_ENDINGS = [".js", ".jsx", ".ts", ".tsx", ".html", ".htm", ".css", ".json", ".xml", ".yaml", ".yml", ".md", ".csv", ".ini", ".conf", ".config"]
_WHITE = r"[\t\n\x{0B}\f\r ]"


def _url(x: str) -> str:
    parts = f"string_split({x}, '.')"
    return f"(contains({x}, '/') OR contains({x}, chr(92)) OR (len({parts}) >= 2 AND NOT regexp_matches({x}, '[\\t\\n\\x{{0B}}\\f\\r \\x{{85}}\\x{{A0}}]') AND strlen({parts}[-1]) >= 2))"


@query("input_lines", f"SELECT line, {_url('line')} AS url_or_path, {S.any_of('line', _MARKS)} AS code FROM (SELECT DISTINCT line FROM (SELECT unnest(string_split(html, chr(10))) AS line FROM pages UNION ALL SELECT url FROM pages UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents))")
def input_lines(spark, d):
    pages, docs = E.table(spark, d, "pages"), E.table(spark, d, "documents")
    lines = pages.select(F.explode(F.split("html", "\n"))).union(pages.select("url")).union(docs.select(F.explode(F.split("text", " ")))).toDF("line").distinct()
    return lines.select("line", inputs.url_or_path(F.col("line")).alias("url_or_path"), inputs.code_line(F.col("line")).alias("code"))


_NAME = "concat('list', doc_id, CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.list' WHEN 2 THEN '.js' WHEN 3 THEN '' WHEN 4 THEN '.URLS' WHEN 5 THEN '.md' ELSE '.txt' END)"
_TEXT = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat('# hosts', chr(10), repeat(concat('https://h', doc_id, '.test/x', chr(10)), cast(doc_id % 13 as int))) ELSE concat(repeat(concat(' host', doc_id, '.test ', chr(10)), cast(doc_id % 15 as int)), 'plain words') END"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_WHITE}+|{_WHITE}+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#'))"


def _like(k: int) -> str:
    return f"len(list_filter(l[1:{k}], lambda x: {_url('x')}))"


@query(
    "input_lists",
    f"""SELECT doc_id, CASE WHEN len(l) = 0 OR e IN ({", ".join(map(S.q, _ENDINGS))}) THEN false WHEN e IN ('.list', '.urls') THEN true
WHEN e = '.txt' THEN CASE WHEN len(l) < 10 AND len(list_filter(l, lambda x: {S.any_of('x', _MARKS)})) > 0 THEN false ELSE {_like(10)} >= least(5, len(l) // 2) END
ELSE len(l) > 5 AND {_like(5)} >= least(3, len(l) // 2) END AS is_list
FROM (SELECT doc_id, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) AS e, {_LINES} AS l FROM (SELECT doc_id, {_NAME} AS name, coalesce({_TEXT}, '') AS text FROM documents))""",
)
def input_lists(spark, d):
    rows = E.table(spark, d, "documents").select("doc_id", F.expr(_NAME).alias("name"), F.coalesce(F.expr(_TEXT), F.lit("")).alias("text"))
    return rows.select("doc_id", inputs.url_list(F.col("name"), F.col("text")).alias("is_list"))


# ---- catalog

CASES = {"default": {}, "include": {"include": ["cloud", " PII ", "crypto"]}, "exclude": {"exclude": ["cloud", "url"]}, "urls": {"scan_urls": True}}
_ROWS = f"(VALUES {', '.join(f'({S.q(p.name)}, {S.q(p.category.lower())}, {str(p.enabled).lower()}, {str(bool(p.regex)).lower()})' for p in E.BUILTIN.values())}) t(name, category, enabled, has_regex)"
_CHOICES = {
    "default": ("true", "enabled"),
    "include": ("category IN ('cloud', 'pii', 'crypto')", "true"),
    "exclude": ("category NOT IN ('cloud', 'url')", "enabled"),
    "urls": ("category = 'url'", "true"),
}


@query(
    "catalog_selection",
    " UNION ALL ".join(
        f"SELECT '{case}' AS selection, count(*)::INT AS total, count_if(NOT ({chosen}))::INT AS skipped_by_category, count_if(({chosen}) AND NOT ({on}))::INT AS skipped_disabled, count_if(({chosen}) AND ({on}) AND NOT (has_regex AND category <> ''))::INT AS failed_validation, count_if(({chosen}) AND ({on}) AND has_regex AND category <> '')::INT AS loaded FROM {_ROWS}"
        for case, (chosen, on) in _CHOICES.items()
    ),
)
def catalog_selection(spark, d):
    rows = []
    for name, how in CASES.items():
        s = catalog.select(E.BUILTIN.values(), **how)[1]
        rows.append((name, s.total, s.skipped_by_category, s.skipped_disabled, s.failed_validation, s.loaded))
    return spark.createDataFrame(rows, "selection string, total int, skipped_by_category int, skipped_disabled int, failed_validation int, loaded int")


@query("catalog_categories", f"SELECT category, count(*) AS patterns FROM {_ROWS} WHERE enabled AND has_regex AND category <> '' GROUP BY category")
def catalog_categories(spark, d):
    return catalog.catalog_frame(spark, catalog.select(E.BUILTIN.values())[0]).groupBy(F.lower("category").alias("category")).agg(F.count("*").alias("patterns"))


# ---- reports

_RAW = f"SELECT DISTINCT source_url, type, value FROM ({E.SHARED_SCAN})"


def _cell(x: str) -> str:
    return f"""concat('"', replace({x}, '"', '""'), '"')"""


@query("report_csv_raw", f"SELECT source_url, value, {_cell('value')} AS line FROM ({_RAW})")
def report_csv_raw(spark, d):
    return sinks.raw_lines(E.shared(spark, d), "csv")


@query("report_csv_raw_grouped", f"SELECT source_url, value, concat({_cell('source_url')}, ',', {_cell('value')}) AS line FROM ({_RAW})")
def report_csv_raw_grouped(spark, d):
    return sinks.raw_lines(E.shared(spark, d), "csv", group=True)


@query("report_txt_raw", f"SELECT source_url, value, value AS line FROM ({_RAW})")
def report_txt_raw(spark, d):
    return sinks.raw_lines(E.shared(spark, d), "txt")


@query("report_txt_raw_grouped", f"SELECT source_url, value, concat(chr(9), value) AS line FROM ({_RAW})")
def report_txt_raw_grouped(spark, d):
    return sinks.raw_lines(E.shared(spark, d), "txt", group=True)


@query("report_json_raw", f"SELECT source_url, value, to_json(value)::VARCHAR AS line FROM ({_RAW})")
def report_json_raw(spark, d):
    return sinks.raw_lines(E.shared(spark, d), "json")


@query("report_json_raw_grouped", f"SELECT source_url, to_json(list_sort(list(value)))::VARCHAR AS line FROM ({_RAW}) GROUP BY source_url")
def report_json_raw_grouped(spark, d):
    return sinks.raw_lines(E.shared(spark, d), "json", group=True)


@query(
    "report_txt_grouped",
    f"""SELECT source_url, type, value, concat(chr(9), '[', type, '] ', value, chr(10), chr(9), 'Risk: ', risk, chr(10), CASE WHEN occurrences > 1 THEN concat(chr(9), 'Occurrences: ', occurrences, chr(10)) ELSE '' END, chr(9), 'Context: ', array_to_string(context, ' | '), chr(10), chr(9), 'Description: ', description, chr(10), chr(10)) AS block FROM ({E.DEDUPED})""",
)
def report_txt_grouped(spark, d):
    return sinks.txt_blocks(E.findings_deduped(spark, d), "\t", False)


@query("report_json_grouped", f"SELECT source_url, len(list(value))::INT AS n, to_json(list({{'type': type, 'risk': risk, 'value': value, 'source_url': source_url, 'context': context, 'occurrences': occurrences, 'description': description}} ORDER BY type, value))::VARCHAR AS records FROM ({E.DEDUPED}) GROUP BY source_url")
def report_json_grouped(spark, d):
    return sinks.json_groups(E.findings_deduped(spark, d))


@query(
    "findings_log_lines",
    f"""SELECT type, value, source_url, concat('[', CASE min(risk) WHEN 'informative' THEN 'INFO-RISK' WHEN 'low' THEN 'LOW' WHEN 'high' THEN 'HIGH' ELSE 'MEDIUM' END, '] Found ', CASE WHEN count(*) > 1 THEN concat(count(*), 'x ') ELSE '' END, type, ': ', CASE WHEN strlen(value) <= 35 THEN value ELSE concat(substr(value, 1, 32), '...') END, '... in ', source_url) AS line
FROM ({E.SHARED_SCAN}) GROUP BY type, value, source_url""",
)
def findings_log_lines(spark, d):
    return findings.log_lines(E.shared(spark, d))


# ---- streams


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(E.table(spark, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def _shared_stream(spark: SparkSession, d: str) -> DataFrame:
    # A batch has as few tasks as its files have row groups, so the rows are dealt out before their texts are made.
    texts = E.finely(_stream(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), E.table(spark, d, "orders")).select(F.expr(E.SHARED_SOURCE).alias("source_url"), F.expr(E.SHARED).alias("content"))
    return streams.scan_stream(texts, [E.BUILTIN["aws_access_key"]])


@query("stream_counts", f"SELECT type, value, source_url, count(*) AS occurrences FROM ({E.SHARED_SCAN}) GROUP BY type, value, source_url")
def stream_counts(spark, d):
    return streams.run_counts(streams.count_stream(_shared_stream(spark, d)))


@query("stream_first_seen", f"SELECT DISTINCT type, value, source_url FROM ({E.SHARED_SCAN})")
def stream_first_seen(spark, d):
    seen = streams.first_seen(_shared_stream(spark, d).withColumn("seen_at", F.lit("2024-01-01 00:00:00").cast("timestamp")), "seen_at")
    return streams.run_to_table(seen.select("type", "value", "source_url"))


@query(
    "stream_backoff",
    f"""WITH f AS (SELECT *, (status = 429 AND lag(status) OVER (PARTITION BY domain ORDER BY ts, status) = 429) AS again FROM ({E.FETCHES_SQL}) WHERE status = 429 OR status BETWEEN 200 AND 299),
e AS (SELECT domain, min((ts, status)) FILTER (WHERE again) AS ended FROM f GROUP BY domain)
SELECT domain, ts, CASE WHEN again THEN 'discard' ELSE 'block' END AS action, CASE WHEN NOT coalesce(again, false) THEN ts + INTERVAL 10 SECONDS END AS until
FROM f JOIN e USING (domain) WHERE status = 429 AND (ended IS NULL OR (ts, status) <= ended)""",
)
def stream_backoff(spark, d):
    status = F.expr("CASE WHEN event_type = 'error' THEN 429 WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 13 = 0 THEN 503 ELSE 200 END")
    rows = _stream(spark, d, "events").select(F.expr("concat('host', event_id % 3001, '.test')").alias("domain"), "ts", status.alias("status"))
    return streams.run_to_table(streams.backoff_stream(rows))


# ---- rate limits

RATE = 2.0
_AT = "1704067200000 + event_id * 50 + (event_id % 17) * (event_id % 5)"


@query(
    "token_bucket",
    f"""WITH RECURSIVE r AS (SELECT concat('host', event_id % 7, '.test') AS domain, epoch_ms({_AT}) AS ts, event_id AS seq, epoch_us(epoch_ms({_AT})) / 1e6 AS t FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) AS k FROM r),
b AS (SELECT domain, ts, seq, k, t, true AS allowed, {RATE}::DOUBLE - 1 AS tokens FROM n WHERE k = 1
UNION ALL
SELECT domain, ts, seq, k, t, filled >= 1, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END
FROM (SELECT n.*, least({RATE}::DOUBLE, b.tokens + (n.t - b.t) * {RATE}) AS filled FROM b JOIN n ON n.domain = b.domain AND n.k = b.k + 1))
SELECT domain, seq, allowed FROM b""",
)
def token_bucket(spark, d):
    rows = E.table(spark, d, "events").select(F.expr("concat('host', event_id % 7, '.test')").alias("domain"), F.timestamp_millis(F.expr(_AT)).alias("ts"), F.col("event_id").alias("seq"), F.lit(200).alias("status"))
    return buckets.allowed(rows, RATE).select("domain", "seq", "allowed")
