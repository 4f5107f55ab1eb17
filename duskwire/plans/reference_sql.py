"""DuckDB SQL that says, independently of the Spark expressions, what a scan should find.

Regular expressions stay as the catalog has them (DuckDB runs RE2). Multi-byte characters
are flattened to as many question marks as they have bytes before a context is cut by
bytes, which changes nothing that the heuristics look for.
"""

from __future__ import annotations

from collections.abc import Iterable

from duskwire.functions.dialect import groups
from duskwire.functions.risk import risk_of
from duskwire.plans import reference_terms as H
from duskwire.sources.catalog import Pattern

# Substrings that a value of the matches dialect must not have.
UNWANTED = ["example", "sample", "test", "placeholder", "dummy", "http://", "https://", "localhost", "127.0.0.1", "node_modules", "charset=", "@example.com"]


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def any_of(text: str, terms: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def starts(text: str, terms: Iterable[str]) -> str:
    return "(" + " OR ".join(f"starts_with({text}, {q(t)})" for t in terms) + ")"


def times(text: str, term: str) -> str:
    return f"((strlen({text}) - strlen(replace({text}, {q(term)}, ''))) // {len(term.encode())})"


def count_of(text: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {q(t)})::INT" for t in terms) + ")"


def _chars(v: str) -> str:
    return f"list_distinct(string_split({v}, ''))"


def entropy(v: str) -> str:
    share = f"((length({v}) - length(replace({v}, ch, ''))) / length({v})::DOUBLE)"
    return f"coalesce(list_sum(list_transform({_chars(v)}, lambda ch: -({share}) * log2({share}))), 0)"


def heuristics(v: str = "v", c: str = "c") -> dict[str, str]:
    """SQL of each heuristic on a value and its context."""
    low, words = f"lower({v})", "|".join(H.AUTH)
    camel = f"regexp_matches({v}, '^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$')"
    events = [a + e for a in (*H.COMPONENTS, "Did", "Will", "On", "After", "Before") for e in H.EVENTS]
    return {
        "file_path": f"({any_of(v, ['/', chr(92)])} AND {any_of(v, H.PATH_PARTS)})",
        "content_type": any_of(low, H.CONTENT_TYPES),
        "code": any_of(v, H.CODE_WORDS),
        "translation": f"({any_of(low, H.TRANSLATION)} OR {times(v, '_')} >= 3 OR {times(v, '.')} >= 2)",
        "i18n": f"(({times(v, '_')} >= 2 AND strlen({v}) > 20) OR {starts(low, H.I18N)})",
        "minified_pattern": f"({count_of(c, H.MINI_MARKS)} >= 3 OR regexp_matches({c}, '[a-z]\\.[a-z]\\.[a-z]') OR regexp_matches({c}, '[a-z]\\([a-z],[a-z]\\)') OR regexp_matches({c}, 'var [a-z]=[^;]+,[a-z]=') OR regexp_matches({v}, '^[A-Za-z][0-9][A-Za-z][0-9]') OR regexp_matches({v}, '[a-z][A-Z][0-9][a-z][A-Z]'))",
        "minified": f"((strlen({c}) > 100 AND {times(c, chr(10))} < 3) OR {' + '.join(times(c, o) for o in H.OPERATORS)} > 5 OR {count_of(c, H.MINI_BLOCKS)} >= 3)",
        "css": f"(starts_with({v}, '--') OR {any_of(v, H.CSS)})",
        "uuid": f"regexp_matches({v}, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')",
        "repeats": f"(strlen({v}) >= 20 AND (list_bool_or(list_transform({_chars(v)}, lambda ch: contains({v}, repeat(ch, 6)))) OR (strlen({v}) >= 30 AND len({_chars(v)}) <= 5 AND list_bool_or(list_transform({_chars(v)}, lambda ch: (length({v}) - length(replace({v}, ch, ''))) / strlen({v})::DOUBLE > 0.3)))))",
        "documentation": any_of(low, H.DOC_WORDS),
        "documentation_context": any_of(f"lower({c})", H.DOC_WORDS),
        "function_name": f"({camel} OR {starts(low, H.VERBS)})",
        "url": any_of(v, H.URLS),
        "js_function": f"(({camel} AND ({starts(low, H.JS_VERBS)} OR {any_of(v, events)})) OR regexp_matches({v}, '(?i)(transition|verify|enable|display|is|has|can)[A-Z][a-zA-Z]*({words})') OR regexp_matches({v}, '(?i)(is|has|can|should|will|did)({words})[A-Z][a-zA-Z]*'))",
        "js_constant": f"(regexp_matches({v}, '^[A-Z][A-Z0-9_]*$') OR {starts(v, H.CONSTANTS)})",
        "placeholder_email": f"({starts(low, H.PLACEHOLDER_PREFIXES)} OR {' OR '.join(f'ends_with({low}, {q(t)})' for t in H.PLACEHOLDER_DOMAINS)})",
        "classes": f"(regexp_matches({v}, '\\p{{Ll}}')::INT + regexp_matches({v}, '\\p{{Lu}}')::INT + regexp_matches({v}, '\\p{{Nd}}')::INT + regexp_matches({v}, '[^\\p{{Ll}}\\p{{Lu}}\\p{{Nd}}]')::INT)",
    }


def _hits(terms: Iterable[str]) -> str:
    low = [t.strip().lower() for t in terms if t.strip()]
    return "(" + " + ".join(["0", *[f"(contains(lower(v), {q(t)}) OR contains(lower(c), {q(t)}))::INT" for t in low]]) + ")"


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _one(p: Pattern, dialect: str) -> str:
    """Scored candidates of one pattern."""
    h, local = heuristics(), dialect != "remote"
    gate, low = p.entropy_gate, p.name.lower()
    matches = f"SELECT source_url, content, unnest(regexp_extract_all(content, {q(p.regex)}, 0)) AS m0, {f'unnest(regexp_extract_all(content, {q(p.regex)}, 1))' if groups(p.regex) else 'NULL'} AS m1 FROM content"
    if dialect == "matches":
        values = f"SELECT DISTINCT source_url, content, v FROM (SELECT source_url, content, m0 AS v FROM ({matches}) UNION ALL SELECT source_url, content, m1 FROM ({matches}) WHERE coalesce(m1, '') <> '')"
    else:
        values = f"SELECT source_url, content, coalesce(nullif(m1, ''), m0) AS v FROM ({matches})"
    placed = f"SELECT *, strlen(substr(content, 1, instr(content, v) - 1)) AS pos FROM ({values})"
    flat = "regexp_replace(regexp_replace(regexp_replace(content, '[\\x{80}-\\x{7FF}]', '??', 'g'), '[\\x{800}-\\x{FFFF}]', '???', 'g'), '[\\x{10000}-\\x{10FFFF}]', '????', 'g')"
    window = f"substr({flat}, greatest(pos - 100, 0) + 1, pos + strlen(v) + 100 - greatest(pos - 100, 0))"
    line = "0" if dialect == "remote" else f"CASE WHEN contains(v, chr(10)) THEN 0 ELSE {times('substr(content, 1, instr(content, v) - 1)', chr(10))} + 1 END"
    rows = f"SELECT source_url, v, {'content' if dialect == 'matches' else window} AS c, {window} AS shown, ({line})::INT AS line FROM ({placed})"
    outside = f"({h['file_path']} OR {h['content_type']} OR {h['code']})"
    if dialect == "remote":
        rows = f"SELECT * FROM ({rows}) WHERE strlen(v) BETWEEN 5 AND 200 AND NOT {outside}"
    if dialect == "matches":
        rows = f"SELECT * FROM ({rows}) WHERE strlen(v) BETWEEN 4 AND 500 AND NOT {outside} AND NOT {any_of('v', UNWANTED)}"
    need = [t.strip().lower() for t in p.requiredcontextany if t.strip()]
    odd = " OR ".join(h[k] for k in ("css", "i18n", "function_name", "url", "documentation", "repeats", "uuid"))
    guards = [
        ("too_short", f"strlen(v) < {p.minlength}"),
        ("too_long", f"{p.maxlength} > 0 AND strlen(v) > {p.maxlength}"),
        ("excluded", " OR ".join(f"regexp_matches(v, {q(x)}) OR regexp_matches(c, {q(x)})" for x in p.excluderegexes) or "false"),
        ("uuid", h["uuid"]),
        ("path_or_content_type", f"{q(p.category.lower())} <> 'url' AND ({h['file_path']} OR {h['content_type']})"),
        ("code_pattern", f"{h['code']} AND strlen(v) < 40"),
        ("placeholder_email", h["placeholder_email"] if "email" in low else "false"),
        ("required_context", f"NOT {any_of('lower(c)', need)}" if need else ("true" if p.requiredcontextany else "false")),
        ("entropy", f"NOT (strlen(v) >= {gate[1]} AND NOT ({odd}) AND {h['classes']} >= 2 AND {entropy('v')} >= {gate[0]})" if gate else "false"),
    ]
    guard = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in guards) + " END"
    special = [("aws", "AKIA", 0.22), ("google_api", "AIza", 0.22), ("stripe", "sk_live_", 0.20), ("stripe", "pk_live_", 0.20), ("jwt", "eyJ", 0.15), ("github", "ghp_", 0.18), ("github", "github_pat_", 0.18)]
    own = [f"WHEN starts_with(v, '{head}') THEN {_d(x)}" for word, head, x in special if word in low]
    terms = [
        _d(0.08) if gate else f"CASE WHEN strlen(v) >= 20 AND {entropy('v')} >= 3.7 THEN {_d(0.05)} WHEN strlen(v) >= 20 AND {entropy('v')} <= 2.2 THEN {_d(-0.1)} ELSE 0 END",
        f"CASE WHEN regexp_matches(c, {q(H.ASSIGNMENT)}) THEN {_d(0.12)} ELSE 0 END",
        f"CASE WHEN {any_of('lower(c)', H.SIGNALS)} THEN {_d(0.08)} ELSE 0 END",
        f"least({_d(0.12)}, {_hits(p.keywordmatches)} * {_d(0.04)})",
        f"least({_d(0.15)}, {_hits(p.contextboostany)} * {_d(0.05)})",
        f"(-least({_d(0.30)}, {_hits(p.keywordexcludes)} * {_d(0.08)}))",
        f"(-least({_d(0.35)}, {_hits(p.contextpenaltyany)} * {_d(0.10)}))",
        f"CASE WHEN {h['documentation']} OR {h['documentation_context']} THEN {_d(-0.22)} ELSE 0 END",
        f"CASE WHEN {h['translation']} OR {h['i18n']} THEN {_d(-0.18)} ELSE 0 END",
        f"CASE WHEN {h['function_name']} OR {h['js_function']} THEN {_d(-0.15)} ELSE 0 END",
        f"CASE WHEN {h['js_constant']} THEN {_d(-0.10)} ELSE 0 END",
        f"CASE WHEN {h['minified']} OR {h['minified_pattern']} THEN {_d(-0.12)} ELSE 0 END",
        f"CASE {' '.join(own)} ELSE 0 END" if own else "0",
        _d(0.05) if local else "0",
    ]
    total = " + ".join([_d(0.55), *terms])
    text = q(p.description) if dialect == "local" else "''"
    scored = f"SELECT *, {guard} AS guard FROM ({rows})"
    scored = f"SELECT *, CASE WHEN guard IS NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, {total})) ELSE 0.0::DOUBLE END AS confidence FROM ({scored})"
    accepted = {"local": "confidence >= 0.5", "remote": "confidence >= 0.5", "matches": "confidence >= 0.45"}[dialect]
    return f"SELECT {q(p.name)} AS type, '{risk_of(p.name, p.category)}' AS risk, v AS value, source_url, shown AS context, line, confidence, {text} AS description, guard, guard IS NULL AND {accepted} AS accepted FROM ({scored})"


def scored_sql(content: str, patterns: Iterable[Pattern], dialect: str = "local") -> str:
    """Every candidate; ``content`` is a query of ``source_url, content``."""
    own = f"SELECT source_url, content FROM ({content}) WHERE content IS NOT NULL"
    if dialect == "remote":
        own += " AND NOT regexp_matches(lower(coalesce(source_url, '')), '\\.(min|bundle|packed|compressed)\\.js$')"
    return f"WITH content AS ({own}) " + " UNION ALL ".join(_one(p, dialect) for p in patterns)


def scan_sql(content: str, patterns: Iterable[Pattern], dialect: str = "local") -> str:
    return f"SELECT type, risk, value, source_url, context, line, confidence, description FROM ({scored_sql(content, patterns, dialect)}) WHERE accepted"


def dedupe_sql(scan: str) -> str:
    """Deduplicated findings, for contexts without outer white space."""
    return f"SELECT type, min(risk) AS risk, value, source_url, list_sort(list(DISTINCT context)) AS context, count(*)::INT AS occurrences, min(description) AS description FROM ({scan}) GROUP BY type, value, source_url"
