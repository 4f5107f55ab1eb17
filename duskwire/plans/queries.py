"""The registered queries of the engine, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwire.functions import heuristics as H
from duskwire.operators import domains, findings
from duskwire.operators.scan import scan, scan_distinct, score_candidates
from duskwire.plans import reference_sql as S
from duskwire.sources import catalog, inputs, sinks
from duskwire.sources.catalog import Pattern
from duskwire.streaming import streams

BUILTIN = {p.name: p for p in catalog.builtin()}
IPIFY = BUILTIN["ipify"]
HEX_TOKEN = Pattern("custom_token", r'token\s*=\s*"([0-9a-f]{40})"', "Custom Token", True, "custom", 8)
PHONE = Pattern("custom_phone", r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})", "Custom Phone", True, "custom", 8)

#: Texts made from orders, the same in Spark and DuckDB; ``m`` is the MD5 of the key.
M = "md5(cast(o_orderkey as string))"
ORDER_TEXTS = {
    "aws": f"concat('aws_access_key_id = \"AKIA', upper(substring({M}, 1, 16)), '\"')",
    "github": f"concat('github_token: \"ghp_', {M}, substring({M}, 1, 4), '\"')",
    "stripe": f"concat('stripe = \"sk_live_', substring({M}, 1, 24), '\"')",
    "google": f"concat('google_key=AIza', {M}, substring({M}, 1, 3))",
    "ipify": f"concat('ipify key ', {M})",
    "assignment": f"concat('api_key = \"', {M}, '\"')",
    "discord": f"concat('discord key ', substring({M}, 1, 24), '.', substring({M}, 1, 6), '.', substring({M}, 1, 27))",
}
MIXED = "CASE o_orderkey % 7 " + " ".join(f"WHEN {k} THEN {text}" for k, text in enumerate(ORDER_TEXTS.values())) + " END"
MIXED_PATTERNS = [BUILTIN[n] for n in ("aws_access_key", "github_token", "github_personal_token", "stripe_secret_key", "google_api_key", "api_key_assignment", "config_api_key", "discord_bot_token")] + [IPIFY]
#: Several texts under one source, with values that recur.
SHARED = "concat('note of ', o_orderpriority, chr(10), 'aws key \"AKIA', upper(substring(md5(cast(o_orderkey % 5 as string)), 1, 16)), '\" and again \"AKIA', upper(substring(md5(cast(o_orderkey % 3 as string)), 1, 16)), '\"')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as there are cores, where a small table has fewer partitions; a large one stays as it is."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


#: Bytes of compact columns that make a task of texts, each many times longer and each scanned.
TEXT_TASK = 500_000


def finely(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Rows of a few compact columns, dealt to tasks whose number grows with them: what a scan makes of them takes long.

    Spark's estimate of their bytes is of the files' sizes and reads nothing; a stream has it ``of`` its table."""
    sized = rows if of is None else of.select(rows.columns)
    size = int(str(sized._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(min(20_000, max(rows.sparkSession.sparkContext.defaultParallelism, size // TEXT_TASK)))


def order_texts(spark: SparkSession, sf_dir: str, text: str, source: str = "concat('orders/', o_orderkey)") -> DataFrame:
    return finely(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).select(F.expr(source).alias("source_url"), F.expr(text).alias("content"))


def _sql(text: str) -> str:
    return text.replace("as string", "as varchar")


def order_sql(text: str, source: str = "concat('orders/', o_orderkey)") -> str:
    return f"SELECT {_sql(source)} AS source_url, {_sql(text)} AS content FROM orders"


SHARED_SOURCE = "concat('customers/', o_custkey)"
DOCUMENTS_SQL = "SELECT concat('documents/', doc_id) AS source_url, text AS content FROM documents"
PAGES_SQL = "SELECT url AS source_url, html AS content FROM pages"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.concat(F.lit("documents/"), "doc_id").alias("source_url"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pages_as_content(spread(table(spark, sf_dir, "pages"))).select("source_url", "content")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# ---- scans


@query("scan_aws_local", S.scan_sql(order_sql(ORDER_TEXTS["aws"]), [BUILTIN["aws_access_key"]]))
def scan_aws_local(spark, d):
    return scan(order_texts(spark, d, ORDER_TEXTS["aws"]), [BUILTIN["aws_access_key"]])


@query("scan_mixed_remote", S.scan_sql(order_sql(MIXED), MIXED_PATTERNS, "remote"))
def scan_mixed_remote(spark, d):
    return scan(order_texts(spark, d, MIXED), MIXED_PATTERNS, "remote")


@query("scan_mixed_local", S.scan_sql(order_sql(MIXED), MIXED_PATTERNS))
def scan_mixed_local(spark, d):
    return scan(order_texts(spark, d, MIXED), MIXED_PATTERNS)


@query("scan_mixed_matches", S.scan_sql(order_sql(MIXED), MIXED_PATTERNS, "matches"))
def scan_mixed_matches(spark, d):
    return scan(order_texts(spark, d, MIXED), MIXED_PATTERNS, "matches")


SCORED = ["type", "value", "source_url", "line", "guard", "confidence", "accepted"]


def scored_sql(content: str, patterns: list[Pattern], dialect: str = "local") -> str:
    return f"SELECT {', '.join(SCORED)} FROM ({S.scored_sql(content, patterns, dialect)})"


CUSTOM = [HEX_TOKEN, PHONE]


@query("score_documents_custom_local", scored_sql(DOCUMENTS_SQL, CUSTOM))
def score_documents_custom_local(spark, d):
    return score_candidates(documents(spark, d), CUSTOM).select(*SCORED)


@query("score_documents_custom_remote", scored_sql(DOCUMENTS_SQL, CUSTOM, "remote"))
def score_documents_custom_remote(spark, d):
    return score_candidates(documents(spark, d), CUSTOM, "remote").select(*SCORED)


EMAIL = [BUILTIN["email_address"]]


@query("score_documents_emails", scored_sql(DOCUMENTS_SQL, EMAIL))
def score_documents_emails(spark, d):
    return score_candidates(documents(spark, d), EMAIL).select(*SCORED)


URL_PATTERNS = catalog.select(catalog.builtin(), scan_urls=True)[0]


@query("score_pages_urls", scored_sql(PAGES_SQL, URL_PATTERNS))
def score_pages_urls(spark, d):
    return score_candidates(pages(spark, d), URL_PATTERNS).select(*SCORED)


#: The whole catalog but ``IPIFY``, which the query names beside it.
ENABLED = catalog.select(p for p in BUILTIN.values() if p != IPIFY)[0]
TALK, ITEM = "concat('conversations/', conv_id, '/', turn)", "concat('benchmark/', item_id)"


# Without SQL: 543 patterns make 16 MB of it, too much for whole tables. ``tests/test_whole_catalog.py`` holds the scan against that SQL, some patterns at a time, on a small fixture.
@query("scan_catalog_all_texts")
def scan_catalog_all_texts(spark, d):
    talk = table(spark, d, "conversations").select(F.expr(TALK).alias("source_url"), F.col("text").alias("content"))
    items = table(spark, d, "benchmark").select(F.expr(ITEM).alias("source_url"), F.col("text").alias("content"))
    texts = documents(spark, d).unionByName(pages(spark, d)).unionByName(order_texts(spark, d, MIXED)).unionByName(talk).unionByName(items)
    return scan(texts, [*ENABLED, IPIFY])


@query("scan_equal_texts_once", S.scan_sql(order_sql(SHARED, SHARED_SOURCE), [BUILTIN["aws_access_key"]]))
def scan_equal_texts_once(spark, d):
    return scan_distinct(order_texts(spark, d, SHARED, SHARED_SOURCE), [BUILTIN["aws_access_key"]])


@query("stream_scan", S.scan_sql(order_sql(MIXED), MIXED_PATTERNS))
def stream_scan(spark, d):
    """The scan as a stream that reads what is there and stops; the sink is then read back."""
    source = spark.readStream.schema(table(spark, d, "orders").schema).option("maxFilesPerTrigger", 100).parquet(f"{d}/order[s].parquet")
    texts = source.select(F.concat(F.lit("orders/"), "o_orderkey").alias("source_url"), F.expr(MIXED).alias("content"))
    return streams.run_to_table(streams.scan_stream(texts, MIXED_PATTERNS))


# ---- findings

SHARED_SCAN = S.scan_sql(order_sql(SHARED, SHARED_SOURCE), [BUILTIN["aws_access_key"]])


def shared(spark, d):
    return scan(order_texts(spark, d, SHARED, SHARED_SOURCE), [BUILTIN["aws_access_key"]])


@query("findings_deduped", S.dedupe_sql(SHARED_SCAN))
def findings_deduped(spark, d):
    return findings.dedupe(shared(spark, d)).withColumn("context", F.array_sort("context"))


@query("findings_grouped", f"SELECT source_url, count(*) AS findings, sum(occurrences)::BIGINT AS occurrences, list_sort(list(value)) AS found FROM ({S.dedupe_sql(SHARED_SCAN)}) GROUP BY source_url")
def findings_grouped(spark, d):
    g = findings.grouped(shared(spark, d))
    return g.select("source_url", F.size("findings").cast("long").alias("findings"), F.aggregate("findings", F.lit(0).cast("long"), lambda a, x: a + x["occurrences"]).alias("occurrences"), F.transform("findings", lambda x: x["value"]).alias("found"))


@query("findings_raw", f"SELECT source_url, value FROM (SELECT DISTINCT type, value, source_url FROM ({SHARED_SCAN}))")
def findings_raw(spark, d):
    return findings.raw_values(shared(spark, d), by_source=True)


@query("findings_unique", f"SELECT type, value, max(source_url) AS source_url FROM ({SHARED_SCAN}) GROUP BY type, value")
def findings_unique(spark, d):
    return findings.unique_secrets(shared(spark, d)).select("type", "value", "source_url")


@query("findings_keys", f"SELECT concat_ws(':', source_url, type, value) AS key, count(*) AS n FROM ({SHARED_SCAN}) GROUP BY 1")
def findings_keys(spark, d):
    return findings.stable_key(shared(spark, d)).groupBy("key").agg(F.count("*").alias("n"))


@query("findings_log", f"SELECT type, value, source_url, count(*) AS n, CASE WHEN strlen(value) <= 35 THEN value ELSE concat(substr(value, 1, 32), '...') END AS shown FROM ({S.scan_sql(order_sql(MIXED), MIXED_PATTERNS)}) GROUP BY type, value, source_url")
def findings_log(spark, d):
    return findings.log_groups(scan_mixed_local(spark, d))


@query("findings_top_types", f"SELECT type, count(*) AS n FROM ({S.scan_sql(order_sql(MIXED), MIXED_PATTERNS)}) GROUP BY type ORDER BY n DESC, type LIMIT 5")
def findings_top_types(spark, d):
    return findings.top(scan_mixed_local(spark, d), "type", 5)


@query("findings_by_risk", f"SELECT risk, count(*) AS n, count(DISTINCT source_url) AS sources FROM ({S.scan_sql(order_sql(MIXED), MIXED_PATTERNS)}) GROUP BY risk")
def findings_by_risk(spark, d):
    return scan_mixed_local(spark, d).groupBy("risk").agg(F.count("*").alias("n"), F.count_distinct("source_url").alias("sources"))


@query(
    "scan_statistics",
    f"""SELECT count(*) AS total, count(strlen(content)) AS processed, count(*) - count(strlen(content)) AS failed, coalesce(sum(n), 0)::BIGINT AS secrets, coalesce(sum(CASE WHEN n > 0 THEN strlen(content) END), 0)::BIGINT AS total_bytes
FROM ({DOCUMENTS_SQL}) LEFT JOIN (SELECT source_url, count(*) AS n FROM ({S.scan_sql(DOCUMENTS_SQL, CUSTOM)}) GROUP BY source_url) USING (source_url)""",
)
def scan_statistics(spark, d):
    texts = documents(spark, d)
    return findings.scan_stats(texts, scan(texts, CUSTOM))


@query("content_cache", f"SELECT sha256(content) AS content_hash, list_sort(list(DISTINCT concat(type, ' ', value))) AS secrets FROM ({S.scan_sql(DOCUMENTS_SQL, CUSTOM)}) JOIN ({DOCUMENTS_SQL}) USING (source_url) GROUP BY 1")
def content_cache(spark, d):
    texts = documents(spark, d)
    kept = findings.content_cache(texts, scan(texts, CUSTOM))
    return kept.select("content_hash", F.array_sort(F.transform("secrets", lambda s: F.concat_ws(" ", s["type"], s["value"]))).alias("secrets"))


# ---- heuristics

VALUES_SQL = "SELECT DISTINCT v, v AS c FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT url FROM pages UNION ALL SELECT unnest(string_split(html, '>')) FROM pages UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents) WHERE v <> ''"


def values(spark, d):
    part, pages_ = table(spark, d, "part"), table(spark, d, "pages")
    each = [part.select("p_name"), part.select("p_type"), table(spark, d, "customer").select("c_name"), pages_.select("url"), pages_.select(F.explode(F.split("html", ">"))), table(spark, d, "documents").select(F.explode(F.split("text", " ")))]
    rows = each[0].toDF("v")
    for x in each[1:]:
        rows = rows.union(x.toDF("v"))
    return spread(rows.where("v <> ''").distinct()).withColumn("c", F.col("v"))


@query("value_heuristics", f"SELECT v, {', '.join(f'{sql} AS {k}' for k, sql in S.heuristics().items() if k not in ('documentation_context', 'classes'))}, ({S.heuristics()['classes']})::INT AS classes, round({S.entropy('v')}, 6) AS entropy FROM ({VALUES_SQL})")
def value_heuristics(spark, d):
    v, c = F.col("v"), F.col("c")
    made = {
        "file_path": H.is_file_path(v), "content_type": H.is_content_type(v), "code": H.has_code_pattern(v), "translation": H.is_translation_key(v), "i18n": H.is_i18n_key(v),
        "minified_pattern": H.is_pattern_in_minified(v, c), "minified": H.is_in_minified(c), "css": H.is_css(v), "uuid": H.is_uuid(v), "repeats": H.has_repeats(v), "documentation": H.is_documentation(v),
        "function_name": H.is_function_name(v), "url": H.is_url(v), "js_function": H.is_js_function(v), "js_constant": H.is_js_constant(v), "placeholder_email": H.is_placeholder_email(v),
        "classes": H.char_classes(v).cast("int"), "entropy": F.round(H.entropy(v), 6),
    }
    return values(spark, d).select("v", *[x.alias(k) for k, x in made.items()])


# ---- catalog

RISK_VALUES = ", ".join(f"({S.q(p.name)}, {S.q(p.category.lower())})" for p in BUILTIN.values())


@query(
    "catalog_risk",
    f"""SELECT name, category, CASE
  WHEN name IN ({", ".join(map(S.q, ["private_key_content", "private_key_var", "web3_private_key", "aws_secret_key", "github_personal_token", "github_token", "github_fine_grained_token", "gitlab_personal_token", "gitlab_runner_token", "docker_hub_token", "npm_access_token", "slack_token", "sentry_auth_token", "shopify_private_app_token", "shopify_custom_app_token", "stripe_secret_key"]))}) THEN 'high'
  WHEN name IN ('google_recaptcha_key', 'ethereum_address', 'stripe_test_publishable_key', 'stripe_test_secret_key') THEN 'informative'
  WHEN name IN ('google_api_key', 'google_cloud_platform', 'stripe_publishable_key', 'session_token') THEN 'low'
  WHEN category IN ('pii', 'web3') THEN 'informative' WHEN category IN ('gcp', 'generic') THEN 'low' WHEN category = 'cloud' THEN 'medium'
  WHEN category IN ('auth', 'aws', 'azure', 'code', 'config', 'crypto', 'db', 'llm', 'payment', 'ci', 'bash') THEN 'high'
  WHEN regexp_matches(name, 'private|secret|token') THEN CASE WHEN regexp_matches(name, 'publi') THEN 'low' ELSE 'high' END
  WHEN contains(name, 'publishable') THEN 'low' WHEN regexp_matches(name, 'public|email|phone') THEN 'informative' ELSE 'medium' END AS risk
FROM (VALUES {RISK_VALUES}) t(name, category)""",
)
def catalog_risk(spark, d):
    return catalog.risk_frame(spark, BUILTIN.values())


@query("catalog_listing", f"SELECT category, name, description FROM (VALUES {', '.join(f'({S.q(p.category)}, {S.q(p.name)}, {S.q(p.description)}, {str(p.enabled).lower()})' for p in BUILTIN.values())}) t(category, name, description, enabled) WHERE enabled ORDER BY category, name")
def catalog_listing(spark, d):
    return sinks.pattern_listing(catalog.catalog_frame(spark, BUILTIN.values()))


# ---- reports

DEDUPED = S.dedupe_sql(SHARED_SCAN)


@query("report_csv", f"""SELECT source_url, type, value, concat(type, ',', risk, ',"', value, '","', source_url, '",', occurrences, ',"', replace(array_to_string(context, ' | '), '"', '""'), '","', description, '"') AS line FROM ({DEDUPED})""")
def report_csv(spark, d):
    return sinks.csv_lines(findings_deduped(spark, d))


@query(
    "report_txt",
    f"""SELECT source_url, type, value, concat('[', type, '] ', value, chr(10), 'Risk: ', risk, chr(10), 'URL: ', source_url, chr(10), CASE WHEN occurrences > 1 THEN concat('Occurrences: ', occurrences, chr(10)) ELSE '' END, 'Context: ', array_to_string(context, ' | '), chr(10), 'Description: ', description, chr(10), chr(10)) AS block FROM ({DEDUPED})""",
)
def report_txt(spark, d):
    return sinks.txt_blocks(findings_deduped(spark, d))


@query("report_json", f"SELECT source_url, type, value, to_json({{'type': type, 'risk': risk, 'value': value, 'source_url': source_url, 'context': context, 'occurrences': occurrences, 'description': description}})::VARCHAR AS record FROM ({DEDUPED})")
def report_json(spark, d):
    return sinks.json_records(findings_deduped(spark, d))


# ---- URLs and domains

HOST = r"nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)', 1), ':[^:]*$', ''), '')"
URLS_SQL = f"SELECT page_id AS input_pos, url, {HOST} AS domain FROM pages"


def urls(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("input_pos"), "url")


@query("url_domains", f"SELECT url, domain, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+') AS valid FROM ({URLS_SQL})")
def url_domains(spark, d):
    return urls(spark, d).select("url", domains.domain_of(F.col("url")).alias("domain"), domains.is_valid_url(F.col("url")).alias("valid"))


@query("urls_by_domain", f"SELECT domain, count(*) AS n FROM ({URLS_SQL}) WHERE domain IS NOT NULL GROUP BY domain")
def urls_by_domain(spark, d):
    return domains.by_domain(urls(spark, d))


@query("top_domains", f"SELECT domain, count(*) AS n FROM ({URLS_SQL}) WHERE domain IS NOT NULL GROUP BY domain ORDER BY n DESC, domain LIMIT 10")
def top_domains(spark, d):
    return domains.top_domains(urls(spark, d), 10)


QUEUE_SQL = f"""SELECT url, domain, round, row_number() OVER (ORDER BY round, size DESC, domain) AS queue_pos
FROM (SELECT url, domain, row_number() OVER (PARTITION BY domain ORDER BY input_pos, url) AS round, count(*) OVER (PARTITION BY domain) AS size FROM ({URLS_SQL}) WHERE domain IS NOT NULL)"""


@query("url_queue", QUEUE_SQL)
def url_queue(spark, d):
    return domains.round_robin(urls(spark, d))


FETCHES_SQL = "SELECT concat('host', event_id % 3001, '.test') AS domain, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 429 WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 13 = 0 THEN 503 ELSE 200 END AS status, (abs(value) * 1000000)::BIGINT AS duration_ns FROM events"


def fetches(spark, d):
    status = F.expr("CASE WHEN event_type = 'error' THEN 429 WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 13 = 0 THEN 503 ELSE 200 END")
    return table(spark, d, "events").select(F.expr("concat('host', event_id % 3001, '.test')").alias("domain"), "ts", F.col("event_id").alias("seq"), status.alias("status"), F.round(F.abs("value") * 1000000).cast("long").alias("duration_ns"))


@query("status_summary", f"SELECT status, count(*) AS n, row_number() OVER (ORDER BY CASE status WHEN 429 THEN 1 WHEN 403 THEN 2 WHEN 404 THEN 3 WHEN 500 THEN 4 WHEN 502 THEN 5 WHEN 503 THEN 6 WHEN 504 THEN 7 ELSE 8 END, status)::INT AS rank FROM ({FETCHES_SQL}) GROUP BY status")
def status_summary(spark, d):
    return domains.status_summary(fetches(spark, d))


@query("domain_statistics", f"SELECT domain, count(*) AS processed, count_if(status BETWEEN 200 AND 299)::BIGINT AS succeeded, count_if(status NOT BETWEEN 200 AND 299)::BIGINT AS failed, count_if(status = 429)::BIGINT AS rate_limited, max(ts) AS last_access FROM ({FETCHES_SQL}) GROUP BY domain")
def domain_statistics(spark, d):
    return domains.domain_stats(fetches(spark, d))


@query("latency_average", f"SELECT domain, list_reduce(list(duration_ns ORDER BY ts, duration_ns), lambda a, x: CASE WHEN a = 0 THEN x ELSE (a * 3 + x) // 4 END)::BIGINT AS average_ns, count(*) AS n FROM ({FETCHES_SQL}) WHERE status BETWEEN 200 AND 299 GROUP BY domain")
def latency_average(spark, d):
    return domains.ewma_latency(fetches(spark, d))


BACKOFF_SQL = f"""WITH f AS (SELECT *, (status = 429 AND lag(status) OVER (PARTITION BY domain ORDER BY ts, seq) = 429) AS again FROM ({FETCHES_SQL}) WHERE status = 429 OR status BETWEEN 200 AND 299),
e AS (SELECT domain, arg_min(ts, (ts, seq)) AS end_ts, arg_min(seq, (ts, seq)) AS end_seq FROM f WHERE again GROUP BY domain)
SELECT f.domain, count_if(status = 429 AND live)::BIGINT AS blocks, bool_or(end_ts IS NOT NULL) AS discarded, max(end_ts) AS discarded_at, max(CASE WHEN status = 429 AND live THEN ts + INTERVAL 10 SECONDS END) AS last_blocked_until
FROM (SELECT f.*, end_ts, (end_ts IS NULL OR ts < end_ts OR (ts = end_ts AND seq < end_seq)) AS live FROM f LEFT JOIN e USING (domain)) f GROUP BY f.domain"""


@query("rate_limit_backoff", BACKOFF_SQL)
def rate_limit_backoff(spark, d):
    return domains.backoff(fetches(spark, d))


OPEN_AT = "2024-01-25 00:00:00"


@query("open_urls", f"SELECT q.domain, q.seq FROM ({FETCHES_SQL}) q WHERE q.domain NOT IN (SELECT domain FROM ({BACKOFF_SQL}) WHERE discarded OR last_blocked_until > TIMESTAMP '{OPEN_AT}')")
def open_urls(spark, d):
    rows = fetches(spark, d)
    return domains.open_queue(rows.select("domain", "seq"), domains.backoff(rows), F.lit(OPEN_AT).cast("timestamp"))


RESPONSES = "CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'image/png' WHEN 2 THEN '' WHEN 3 THEN 'Application/JSON' END"


@query("response_texts", f"SELECT url AS source_url, CASE WHEN t IS NULL OR t = '' OR contains(t, 'text/html') OR contains(t, 'application/json') THEN html ELSE '' END AS content FROM (SELECT *, lower({RESPONSES}) AS t, 200 + (page_id % 4) * 50 AS status FROM pages) WHERE status BETWEEN 200 AND 299")
def response_texts(spark, d):
    rows = table(spark, d, "pages").select("url", F.expr(RESPONSES).alias("content_type"), F.expr("200 + (page_id % 4) * 50").alias("status"), F.col("html").alias("body"))
    return inputs.response_content(rows)


# ---- the rest of the library

from duskwire.plans import library_queries, more_queries  # noqa: E402

QUERIES |= library_queries.QUERIES | more_queries.QUERIES
ORACLES |= library_queries.ORACLES | more_queries.ORACLES
