"""Registered queries of the functions and operators that no scan uses, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwire.functions import library as L
from duskwire.operators import collections
from duskwire.plans import reference_sql as S
from duskwire.plans import reference_terms as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of an order's key; a cast of this form is read alike by Spark and DuckDB.
M = "md5(concat(o_orderkey, ''))"


def m(n: int) -> str:
    return f"substring({M}, 1, {n})"


Q = "chr(39)"
#: Values and their contexts, made from orders; the same expressions in Spark and DuckDB.
SHAPES = [
    (f"concat('eyJ', {m(13)}, '.', {M}, '.', {m(24)})", "concat('const jwt = \"', v, '\";')"),
    (f"concat('eyJ', {m(13)}, '.', {m(8)}, '.', {m(24)})", "concat('plain text with ', v, ' inside')"),
    (f"concat({m(12)}, '.', {M}, '.', {m(16)})", "concat('a note about ', v, ' and nothing else')"),
    (f"concat({m(12)}, '.', {M}, '.', {m(16)})", "concat('<meta http-equiv=\"origin-trial\" content=', v, ' expiry google>')"),
    (f"concat('c2VjcmV0IGtleSBpcyB0aGF0', {m(8)})", "concat('var x=atob(\"', v, '\"); return x; function(){}')"),
    (f"concat('d2VhdGhlciBpcyBncmVhdCBub3cg', {m(7)}, '=')", "concat('let y = ', v)"),
    (f"concat('data:image/png;base64,', {M})", "'url()'"),
    (f"concat('/9j/4', {m(15)})", "concat('img ', v)"),
    (f"concat('AAAA', {m(20)}, '0000')", "'unicode code point table in UTF-8'"),
    (f"concat('getUser', upper({m(1)}), 'okenState')", "'render(createElement(div))'"),
    (f"concat('updateTheMfaFactor', {m(2)}, 'Verify')", "'jQuery selector'"),
    (f"concat('A1B2', upper({m(6)}), 'C3D4xY5z')", "concat('a.b.c=', v, ';var a=1,b=2;')"),
    (f"concat('America/New_York ', {m(4)})", "'|LMT|EST|'"),
    (f"concat(substring('token', 1, 5), ' = ', {m(6)}, '.value')", "'oauth access_token and bearer'"),
    (f"concat('accessToken:', {m(10)})", "'authorization for oauth'"),
    ("CASE o_orderkey % 3 WHEN 0 THEN 'Reset Password' WHEN 1 THEN 'Password' ELSE 'default' END", "'<label for=pw>'"),
    ("CASE o_orderkey % 4 WHEN 0 THEN ':hover' WHEN 1 THEN 'checked' WHEN 2 THEN 'focus-ring' ELSE 'image' END", f"concat('$(', {Q}, 'a', {Q}, ')')"),
    ("CASE o_orderkey % 3 WHEN 0 THEN 'Basic authorization' WHEN 1 THEN 'Basic usage' ELSE 'basic login page' END", "CASE WHEN o_orderkey % 2 = 0 THEN '<h2>head</h2>' ELSE 'body' END"),
    (f"concat('Basic ', {m(24)})", "CASE WHEN o_orderkey % 2 = 0 THEN 'Authorization header' ELSE 'an example' END"),
    (f"concat('AIza', {M}, {m(3)})", "CASE WHEN o_orderkey % 2 = 0 THEN 'https://fonts.googleapis.com/css?key=' ELSE 'maps' END"),
    (f"concat('G-', upper({m(10)}))", "'gtag config'"),
    (f"concat({m(8)}, '-', {m(4)}, '-', {m(4)}, '-', {m(4)}, '-', {m(12)})", "'id'"),
    (f"concat('G-1AB2CD34', upper({m(2)}))", "'analytics'"),
    (f"concat({M}, {M})", "concat('x', chr(10), 'y;z;w;v;u', chr(10), 'a++')"),
    (f"concat('über', upper({m(1)}), 'öÄ', {m(5)}, '12É')", "'Größe UTF-16 BMP'"),
]

def _case(side: int) -> str:
    n = len(SHAPES)
    return f"CASE o_orderkey % {n} " + " ".join(f"WHEN {k} THEN {s[side]}" for k, s in enumerate(SHAPES)) + " END"


SHAPED_SQL = f"SELECT v, kind, {_case(1)} AS c FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'aws_key' WHEN 1 THEN 'jwt_token' WHEN 2 THEN 'other' ELSE 'google_api' END AS kind, {_case(0)} AS v FROM orders)"
WORDS_SQL = "SELECT v, 'other' AS kind, v AS c FROM (SELECT DISTINCT v FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT url FROM pages UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents) WHERE v <> '')"
BOTH_SQL = f"SELECT DISTINCT v, kind, c FROM ({SHAPED_SQL} UNION ALL {WORDS_SQL})"


def both(spark: SparkSession, d: str) -> DataFrame:
    """``v, kind, c``: made values with their contexts, and the words of the tables as their own context."""
    shaped = table(spark, d, "orders").select("o_orderkey").withColumn("v", F.expr(_case(0))).withColumn("c", F.expr(_case(1)))
    kind = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'aws_key' WHEN 1 THEN 'jwt_token' WHEN 2 THEN 'other' ELSE 'google_api' END")
    part = table(spark, d, "part")
    each = [part.select("p_name"), part.select("p_type"), table(spark, d, "customer").select("c_name"), table(spark, d, "pages").select("url"), table(spark, d, "documents").select(F.explode(F.split("text", " ")))]
    words = each[0].toDF("v")
    for x in each[1:]:
        words = words.union(x.toDF("v"))
    words = words.where("v <> ''").distinct().select("v", F.lit("other").alias("kind"), F.col("v").alias("c"))
    return shaped.select("v", kind.alias("kind"), "c").unionByName(words).distinct()


def _low(terms) -> list[str]:
    return [x.lower() for x in terms]


def _words(terms) -> str:
    return "(" + ", ".join(map(S.q, terms)) + ")"


_SHAPE = "(strlen({v}) > 0 AND (strlen({v}) % 4 = 0 OR ends_with({v}, '=')) AND regexp_full_match({v}, '[A-Za-z0-9+/]*={{0,2}}'))"


def _shape(v: str) -> str:
    return _SHAPE.format(v=v)


_H = S.heuristics()
_S = r"[\t\n\f\r ]"
_CUT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(\p{Ll})(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '(\p{Lu}\p{Lu})(\p{Ll})', '\1' || chr(1) || '\2', 'g'), '(\p{Nd})([^\p{Nd}\x01])', '\1' || chr(1) || '\2', 'g'), '([^\p{Nd}\x01])(\p{Nd})', '\1' || chr(1) || '\2', 'g')"
_PIECES = f"list_filter(string_split({_CUT}, chr(1)), lambda x: x <> '')"
_CAMEL_PIECES = r"list_filter(string_split(regexp_replace(v, '(\p{Lu})', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '')"


def _hits(pattern: str) -> str:
    return f"len(regexp_extract_all(v, '{pattern}'))"


_JWT = "split_part(v, '.', {i})"

VALUE_SQL = {
    "common": f"lower(v) IN {_words(T.COMMON_WORDS)}",
    "base64_shape": _shape("v"),
    "candidate": f"strlen(v) >= CASE kind WHEN 'aws_key' THEN 16 WHEN 'google_api' THEN 16 WHEN 'jwt_token' THEN 20 ELSE 8 END AND NOT {_H['translation']} AND NOT {_H['code']} AND NOT {_H['file_path']} AND NOT {_H['content_type']} AND NOT ({S.times('v', '-')} = 4 AND strlen(v) BETWEEN 32 AND 36 AND substr(hex(encode(v)), 17, 2) = '2D' AND substr(hex(encode(v)), 27, 2) = '2D' AND substr(hex(encode(v)), 37, 2) = '2D' AND substr(hex(encode(v)), 47, 2) = '2D')",
    "time_zone": f"{S.any_of('lower(v)', _low(T.TIME_ZONES))} OR {S.any_of('v', T.TIME_ZONE_DIGITS)}",
    "minified_sequence": f"{_hits('[A-Z][0-9][A-Z][0-9]')} + {_hits('[a-z][A-Z][0-9][a-z][A-Z]')} + {_hits('[A-Z]{1,2}[0-9]{1,2}[A-Z]{1,2}')} >= 3 OR (len({_PIECES}) >= 5 AND len(list_filter({_PIECES}, lambda x: strlen(x) <= 3)) / len({_PIECES}) > 0.7)",
    "pieces": f"len({_PIECES})::INT",
    "camel_pieces": f"len({_CAMEL_PIECES})::INT",
    "unicode_plane": S.any_of("lower(c)", _low(T.UNICODE_PLANES)),
    "analytics": "regexp_full_match(v, 'G-[A-Z0-9]{10}') AND NOT regexp_matches(v, 'G-[0-9]{1,2}[A-Z]{1,2}[0-9]{1,2}[A-Z]{1,2}[0-9]{1,2}')",
    "oauth": f"{S.count_of('lower(c)', T.OAUTH)} >= 2",
    "base64_data": f"contains(v, 'data:image') OR contains(v, 'base64') OR (strlen(v) > 40 AND {_shape('v')})",
    "basic_auth": f"starts_with(v, 'Basic usage') OR {S.any_of('lower(c)', T.BASIC_DOCS)} OR NOT (starts_with(v, 'Basic ') AND {_shape('substr(v, 7)')} AND strlen(substr(v, 7)) > 10)",
    "minified_code": f"(strlen(c) > 200 AND {S.times('c', chr(10))} < strlen(c) // 200) OR ({S.times('c', chr(10))} > 0 AND {S.times('c', ';')} > {S.times('c', chr(10))} * 3) OR regexp_matches(c, '[a-z]\\.[a-z]\\.|[a-z]\\([a-z],[a-z]\\)|var [a-z]=[^;]+,[a-z]=|[a-z]\\+\\+|[a-z]--') OR {S.count_of('c', T.MINIFIED)} >= 3",
    "camel_case": f"regexp_matches(v, '^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$') AND list_has_any(list_transform({_CAMEL_PIECES}, lambda x: lower(x)), [{', '.join(map(S.q, _low(T.CAMEL_WORDS)))}])",
    "origin_trial": f"{S.count_of('lower(c)', T.ORIGIN_TRIAL)} >= 2",
    "variable": f"{S.any_of('v', T.VARIABLES)} OR regexp_full_match(v, '{_S}*[a-zA-Z0-9_]+{_S}*[.:=]{_S}*[a-zA-Z0-9_.]+{_S}*')",
    "ui_text": f"v IN {_words(T.UI_LABELS)} OR {S.any_of('lower(c)', _low(T.UI_CONTEXTS))}",
    "unicode": f"{S.any_of('v', T.UNICODE_TERMS)} OR {S.any_of('c', T.UNICODE_TERMS)}",
    "google_font": f"starts_with(v, 'AIza') AND {S.any_of('c', T.GOOGLE_FONTS)}",
    "dom_selector": f"{S.any_of('v', T.PSEUDO_CLASSES)} OR v IN {_words([x[1:] for x in T.PSEUDO_CLASSES])} OR {S.any_of('c', T.SELECTORS)}",
    "ui_header": f"{S.any_of('c', T.HEADER_MARKS)} AND {S.starts('lower(v)', ['basic ' + x for x in T.UI_HEADERS])}",
    "jwt": f"len(string_split(v, '.')) = 3 AND {' AND '.join(_shape(_JWT.format(i=i)) for i in (1, 2, 3))} AND strlen({_JWT.format(i=1)}) >= 10 AND strlen({_JWT.format(i=2)}) >= strlen({_JWT.format(i=1)}) AND strlen({_JWT.format(i=3)}) >= 16 AND starts_with(v, 'eyJ') AND regexp_matches({_JWT.format(i=3)}, '[A-Za-z0-9_-]+={{0,2}}$')".replace("{{", "{").replace("}}", "}"),
    "piece_of": f"NOT contains(v, '.') OR strlen(v) < 30 OR {S.times('v', '.')} <> 2 OR (contains(c, v) AND {S.count_of('near', T.FRAGMENT_MARKS)} >= 3) OR {S.any_of('c', T.FRAGMENT_CONTEXTS)} OR ({_H['minified']} AND NOT {S.any_of('lower(c)', T.FRAGMENT_AUTH)})",
    "long_base64": f"strlen(v) >= 40 AND regexp_full_match(v, '[A-Za-z0-9+/=]+') AND {S.count_of('c', T.JS_MARKS)} >= 3",
    "random_password": f"strlen(v) >= 12 AND NOT ({' OR '.join(_H[k] for k in ('css', 'i18n', 'function_name', 'url', 'documentation', 'repeats', 'uuid'))}) AND {_H['classes']} >= 2 AND {S.entropy('v')} >= 3.5",
}
# Bytes around the value, as text in which a character that is cut is left out.
_FLAT = "regexp_replace(c, '[^\\x00-\\x7F]', '?', 'g')"
_NEAR = f"substr({_FLAT}, greatest(0, instr(c, v) - 16) + 1, instr(c, v) - 1 + length(v) + 15 - greatest(0, instr(c, v) - 16))"


@query("library_values", f"SELECT v, kind, c, {', '.join(f'({sql}) AS {k}' for k, sql in VALUE_SQL.items())} FROM (SELECT *, CASE WHEN contains(c, v) THEN {_NEAR} ELSE '' END AS near FROM ({BOTH_SQL}))")
def library_values(spark, d):
    v, c = F.col("v"), F.col("c")
    made = {
        "common": L.is_common_word(v), "base64_shape": L.is_base64_shape(v), "candidate": L.is_secret_candidate(F.col("kind"), v), "time_zone": L.is_time_zone_data(v),
        "minified_sequence": L.is_minified_sequence(v), "pieces": F.size(L.split_camel_or_number(v)), "camel_pieces": F.size(L.split_camel_case(v)), "unicode_plane": L.is_unicode_plane(c),
        "analytics": L.is_analytics_id(v), "oauth": L.is_oauth_context(c), "base64_data": L.is_base64_data(v), "basic_auth": L.is_basic_auth_syntax(v, c), "minified_code": L.is_minified_code(c),
        "camel_case": L.has_camel_case(v), "origin_trial": L.is_origin_trial(c), "variable": L.is_variable_reference(v), "ui_text": L.is_ui_text(v, c), "unicode": L.is_unicode_reference(v, c),
        "google_font": L.is_google_font_key(v, c), "dom_selector": L.is_dom_selector(v, c), "ui_header": L.is_ui_header(v, c), "jwt": L.is_jwt(v), "piece_of": L.is_base64_piece_of(v, c),
        "long_base64": L.is_long_base64_in_code(v, c), "random_password": L.is_random_password(v),
    }
    return both(spark, d).select("v", "kind", "c", *[x.alias(k) for k, x in made.items()])


_BASE64 = "regexp_full_match({v}, '(?:[A-Za-z0-9+/]{{4}})*(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?')"
_FLAT_V = "regexp_replace(v, '[\\r\\n]', '', 'g')"
_HEX = f"CASE WHEN {_BASE64.format(v=_FLAT_V)} THEN hex(from_base64({_FLAT_V})) END"
_ODD = "len(list_filter(regexp_extract_all(substr(x, 1, 200), '..'), lambda b: b < '20' OR b > '7E'))"
_TEXT = "list_reduce(list_prepend('', list_transform(regexp_extract_all(x, '..'), lambda b: chr(('0x' || b)::INT))), lambda a, b: a || b)"
_BINARY = f"coalesce(substr(x, 1, 2) IN {_words(T.BINARY_FIRST)} OR {_ODD} > CASE WHEN length(x) / 2 < 100 THEN length(x) // 10 ELSE 20 END, false)"
_FRAGMENT = f"({S.any_of('v', T.FRAGMENT_HEADS)} OR {S.count_of('v', T.FRAGMENT_RUNS)} >= 2)"
_URI = f"({S.starts('v', T.DATA_URIS)} AND contains(v, ';base64,'))"


@query(
    "library_base64",
    f"SELECT v, {_BASE64.format(v='v')} AS base64, {_URI} AS data_uri, {_BINARY} AS binary_data, {_FRAGMENT} AS fragment, coalesce(NOT {_FRAGMENT} AND {_BASE64.format(v='v')} AND strlen(v) BETWEEN 20 AND 1000 AND NOT {_URI} AND NOT {_BINARY} AND {S.any_of(f'lower({_TEXT})', T.SECRET_WORDS)}, false) AS secret FROM (SELECT DISTINCT v, {_HEX} AS x FROM ({BOTH_SQL}))",
)
def library_base64(spark, d):
    v = F.col("v")
    made = {"base64": L.is_base64(v), "data_uri": L.is_data_uri(v), "binary_data": L.is_binary_base64(v), "fragment": L.is_base64_fragment(v), "secret": L.is_secret_in_base64(v)}
    return both(spark, d).select("v").distinct().select("v", *[x.alias(k) for k, x in made.items()])


MESSAGES = [
    "dial tcp 10.0.0.1:443: connect: connection refused", "read: connection reset by peer", "lookup x.test: no such host", "network is unreachable", "net/http: request TIMEOUT", "the operation timed out",
    "context deadline exceeded", "context canceled", "operation was canceled", "rate limit bucket empty", "Too Many Requests", "please throttle", "HTTP 429", "blocked by WAF", "403 Forbidden", "server is busy, try again",
    "temporary failure in name resolution", "x509: certificate signed by unknown authority", "tls handshake failed", "validation failed", "resource not found", "unexpected end of file", "",
]
_MESSAGE = f"CASE event_id % {len(MESSAGES)} " + " ".join(f"WHEN {k} THEN {S.q(x)}" for k, x in enumerate(MESSAGES)) + " END"
_ERROR_KIND = "CASE (event_id % 7) WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'waf' WHEN 3 THEN 'temporary' WHEN 4 THEN 'certificate' WHEN 5 THEN 'processing' END"
ERRORS_SQL = f"SELECT event_id, {_MESSAGE} AS message, {_ERROR_KIND} AS kind, CASE WHEN event_id % 5 = 0 THEN 404 WHEN event_id % 5 = 1 THEN 500 END AS status FROM events"


def _told(kind: str, terms) -> str:
    return f"CASE WHEN kind IS NULL THEN {S.any_of('lower(message)', terms)} ELSE kind = '{kind}' END"


@query(
    "library_errors",
    f"""SELECT event_id, {S.any_of('lower(message)', T.NETWORK)} AS network, {_told('rate_limit', T.RATE_LIMIT)} AS rate_limit, {_told('waf', T.FIREWALL)} AS firewall, {_told('temporary', T.TEMPORARY)} AS temporary,
{S.any_of('lower(message)', T.TIMEOUT)} AS timed_out, {S.any_of('lower(message)', T.CANCELED)} AS canceled, {S.any_of('lower(message)', T.CERTIFICATE)} OR coalesce(kind = 'certificate', false) AS certificate,
kind IS NOT NULL AND coalesce(status = 404, false) AS not_found, 'fetch: ' || message AS wrapped FROM ({ERRORS_SQL})""",
)
def library_errors(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_MESSAGE).alias("message"), F.expr(_ERROR_KIND).alias("kind"), F.expr("CASE WHEN event_id % 5 = 0 THEN 404 WHEN event_id % 5 = 1 THEN 500 END").alias("status"))
    t, k = F.col("message"), F.col("kind")
    made = {
        "network": L.is_network_error(t), "rate_limit": L.is_rate_limit_error(t, k), "firewall": L.is_firewall_error(t, k), "temporary": L.is_temporary_error(t, k), "timed_out": L.is_timeout_error(t),
        "canceled": L.is_canceled_error(t), "certificate": L.is_certificate_error(t, k), "not_found": L.is_not_found_error(k, F.col("status")), "wrapped": L.wrapped_error(t, F.lit("fetch")),
    }
    return rows.select("event_id", *[x.alias(n) for n, x in made.items()])


PREFIXES, SUFFIXES, TERMS = ["The", "Der", "http"], [".", "!", "</p>"], ["zebra", "engine", "data"]
_UNITS = "CASE WHEN n < 1024 THEN n || ' B' " + " ".join(f"WHEN n < {1024 ** (k + 1)} THEN printf('%.1f {u}B', n / {1024.0**k})" for k, u in enumerate("KMGT", 1)) + " END"


@query(
    "library_strings",
    f"""SELECT doc_id, len(list_filter(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: x <> ''))::INT AS lines, sha256(coalesce(text, '')) AS hashed,
{S.starts("coalesce(text, '')", PREFIXES)} AS has_prefix, ({" OR ".join(f"ends_with(coalesce(text, ''), {S.q(x)})" for x in SUFFIXES)}) AS has_suffix, {S.any_of("coalesce(text, '')", TERMS)} AS has_any,
contains(lower(coalesce(text, '')), lower(coalesce(lang, 'X'))) AS has_lang, {_UNITS} AS size_text,
CASE WHEN s < 60 THEN printf('%.2f seconds', s) WHEN floor(s / 60) < 60 THEN printf('%d minutes %.2f seconds', floor(s / 60)::BIGINT, s - floor(s / 60) * 60) ELSE printf('%d hours %d minutes %.2f seconds', floor(s / 3600)::BIGINT, (floor(s / 60) - floor(s / 3600) * 60)::BIGINT, s - floor(s / 60) * 60) END AS duration_text
FROM (SELECT *, (doc_id * doc_id * 977 + doc_id)::BIGINT AS n, (doc_id * 13 + 0.25)::DOUBLE AS s FROM documents)""",
)
def library_strings(spark, d):
    t = F.coalesce("text", F.lit(""))
    made = {
        "lines": F.size(L.split_lines(t)), "hashed": L.hash_string(t), "has_prefix": L.has_any_prefix(t, PREFIXES), "has_suffix": L.has_any_suffix(t, SUFFIXES), "has_any": L.contains_any(t, TERMS),
        "has_lang": L.contains_ignore_case(t, F.coalesce("lang", F.lit("X"))), "size_text": L.format_bytes(F.col("doc_id") * F.col("doc_id") * 977 + F.col("doc_id")), "duration_text": L.format_duration(F.col("doc_id") * 13 + 0.25),
    }
    return table(spark, d, "documents").select("doc_id", *[x.alias(k) for k, x in made.items()])


#: URLs with and without scheme, path, query and script ending.
_SHAPE_URL = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat(' ', url, '.js ') WHEN 2 THEN concat(url, '.js?v=', page_id) WHEN 3 THEN concat('host', page_id, '.test') WHEN 4 THEN concat('http://h', page_id, '.test?q=', page_id) ELSE concat(url, '/js/x.JS') END"
_VALID = "regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+')"
_SCRIPT = f"({_VALID} AND (ends_with(lower(u), '.js') OR contains(lower(u), '.js?') OR contains(lower(u), '.js&')))"
_FULL = "CASE WHEN starts_with(trim(u), 'http://') OR starts_with(trim(u), 'https://') THEN trim(u) ELSE 'https://' || trim(u) END"


@query(
    "library_urls",
    f"""SELECT page_id, CASE WHEN regexp_matches({_FULL}, '^[A-Za-z]+://[^/?#]+([?#]|$)') THEN regexp_replace({_FULL}, '^([A-Za-z]+://[^/?#]+)', '\\1/') ELSE {_FULL} END AS sanitized, {_SCRIPT} AS script_url,
(ends_with(lower(u), '.js') OR contains(u, '.js?') OR contains(u, '.js&') OR {S.any_of('lower(u)', T.SCRIPT_FOLDERS)}) AS script_file,
CASE WHEN {_SCRIPT} THEN u WHEN contains(u, '?') AND NOT ends_with(u, '?') THEN split_part(u, '?', 1) || '.js?' || substr(u, instr(u, '?') + 1) ELSE u || '.js' END AS enforced,
lower(regexp_extract(u, '(\\.[^./]*)$', 1)) AS extension, lower(regexp_extract(u, '(\\.[^./]*)$', 1)) IN {_words(['', *T.TEXT_EXTENSIONS])} AS text_file FROM (SELECT page_id, {_SHAPE_URL} AS u FROM pages)""",
)
def library_urls(spark, d):
    u = F.col("u")
    made = {"sanitized": L.sanitize_url(u), "script_url": L.is_script_url(u), "script_file": L.is_script_file(u), "enforced": L.enforce_script_extension(u), "extension": L.file_extension(u), "text_file": L.is_text_file(u)}
    return table(spark, d, "pages").select("page_id", F.expr(_SHAPE_URL).alias("u")).select("page_id", *[x.alias(k) for k, x in made.items()])


@query("library_chunks", "SELECT o_orderkey, o_custkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 3)::BIGINT AS chunk FROM orders")
def library_chunks(spark, d):
    return collections.chunks(table(spark, d, "orders"), 3, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "chunk")


@query(
    "library_chunks_by",
    "SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR (lag(event_type) OVER w = event_type) THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
)
def library_chunks_by(spark, d):
    same = lambda before, now: before("event_type") == now("event_type")
    return collections.chunks_by(table(spark, d, "events"), same, ["user_id"], ["ts", "event_id"]).select("event_id", "chunk")


CACHE = 3


@query(
    "library_cache",
    f"""WITH a AS (SELECT user_id % 50 AS owner, event_id AS seq, event_id % 7 AS key FROM events),
p AS (SELECT *, max(seq) FILTER (WHERE true) OVER (PARTITION BY owner, key ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS was FROM a)
SELECT owner, seq, key, was IS NOT NULL AND (SELECT count(DISTINCT a.key) FROM a WHERE a.owner = p.owner AND a.seq > p.was AND a.seq < p.seq) < {CACHE} AS hit FROM p""",
)
def library_cache(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 50).alias("owner"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("key"))
    return collections.cache_hits(rows, CACHE)


@query("library_sorted", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey")
def library_sorted(spark, d):
    return collections.sorted_by(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice"), "p_partkey", descending=True)
