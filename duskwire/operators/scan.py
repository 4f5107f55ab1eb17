"""Scanning texts with a pattern catalog, in three dialects.

The catalog is configuration: it is prepared on the driver and joined as a broadcast
of known size. A scan is map-only. Each text is first held against the literals that
the patterns need, so a regex runs on the few texts that can match it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwire.functions import heuristics as H
from duskwire.functions.dialect import groups, to_java
from duskwire.functions.heuristics import any_in
from duskwire.functions.risk import risk_of
from duskwire.operators.engine import evaluate
from duskwire.sources.catalog import Pattern, java_regex

DIALECTS = ("local", "remote", "matches")
SKIPPED_SUFFIXES = r"\.(?:min|bundle|packed|compressed)\.js\z"
# Substrings that a value of the matches dialect must not have.
UNWANTED = ["example", "sample", "test", "placeholder", "dummy", "http://", "https://", "localhost", "127.0.0.1", "node_modules", "charset=", "@example.com"]

CATALOG = (
    "id int, type string, p_regex string, p_lower string, p_category string, p_description string, p_risk string, p_minlength int, p_maxlength int, p_exclude array<string>, p_need_raw array<string>, "
    "p_need array<string>, p_matches array<string>, p_boost array<string>, p_excludes array<string>, p_penalty array<string>, p_gated boolean, p_bits double, p_least int"
)
FINDING = ["type", "risk", "value", "source_url", "context", "line", "confidence", "description"]


def _terms(raw: Iterable[str]) -> list[str]:
    return [t for t in (x.strip().lower() for x in raw) if t]


def prepared(patterns: list[Pattern]) -> list[tuple]:
    """A row of ``CATALOG`` per pattern."""
    rows = []
    for i, p in enumerate(patterns):
        gate = p.entropy_gate
        rows.append(
            (
                i, p.name, java_regex(p), p.name.lower(), p.category.lower(), p.description, risk_of(p.name, p.category), p.minlength, p.maxlength,
                [to_java(x) for x in p.excluderegexes], list(p.requiredcontextany), _terms(p.requiredcontextany), _terms(p.keywordmatches), _terms(p.contextboostany),
                _terms(p.keywordexcludes), _terms(p.contextpenaltyany), gate is not None, gate[0] if gate else 0.0, gate[1] if gate else 0,
            )
        )
    return rows


def _long_runs(p: Pattern) -> bool:
    """Whether the pattern is of the keyword kind, whose value is a run of 20 or more characters without space."""
    m = re.search(r"\.\{0,40\}\\b\(\[[^\]\s]*\]\{([0-9]+)(?:,[0-9]*)?\}\)\\b$", p.regex)
    return bool(m) and int(m[1]) >= 20


#: Up to so many literals are looked for one by one, which Spark compiles; more by one expression for all.
FEW = 40
#: Up to so many patterns the values of a text are compiled code; of more it would be too much.
COMPILED = 16


def candidate_ids(patterns: list[Pattern], content: Column) -> Column:
    """Ids of the patterns whose needed literals the text holds, or that need none.

    The bulk of a catalog asks for a long unbroken run next to a keyword; one test for
    such a run spares texts without it the search for hundreds of keywords.
    """
    low = F.lower(content)

    def matching(chosen: list[tuple[int, Pattern]]) -> Column:
        by: dict[str, list[int]] = {}
        for i, p in chosen:
            for x in p.literals:
                by.setdefault(x, []).append(i)
        if len(by) <= FEW:
            return F.array_compact(F.array(*[F.when(any_in(low, p.literals), F.lit(i)) for i, p in chosen]))
        return _known(by, F.array_distinct(F.regexp_extract_all(low, F.lit(trie_regex(by)), F.lit(1))))

    free = [i for i, p in enumerate(patterns) if not p.literals]
    runs = [(i, p) for i, p in enumerate(patterns) if p.literals and _long_runs(p)]
    rest = [(i, p) for i, p in enumerate(patterns) if p.literals and not _long_runs(p)]
    none = F.array().cast("array<int>")
    parts = [F.array(*[F.lit(i) for i in free]) if free else none, matching(rest) if rest else none]
    if runs:
        parts.append(F.when(F.rlike(content, F.lit(r"[^\t\n\f\r ]{20}")), matching(runs)).otherwise(none))
    return F.concat(*parts)


def _known(by: dict[str, list[int]], held: Column) -> Column:
    """Ids of the literals ``held``, of which each stands for those that it begins with, too."""
    ids = {x: sorted({i for y, own in by.items() if x.startswith(y) for i in own}) for x in by}
    table = F.from_json(F.lit(json.dumps(ids)), "map<string,array<int>>")
    return F.array_distinct(F.flatten(F.transform(held, lambda x: F.element_at(table, x))))


def trie_regex(literals: Iterable[str]) -> str:
    """An expression whose group 1 is, at every place of a text, the longest of ``literals`` that begins there.

    It consumes nothing, so no literal hides another. Common beginnings are tried once,
    and a class of the first letters passes over places where none can begin.
    """
    tree: dict = {}
    for x in literals:
        at = tree
        for c in x:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(at: dict) -> str:
        heads = sorted(k for k in at if k)
        tails = {c: re.escape(c) + of(at[c]) for c in heads}
        if not heads:
            return ""
        body = next(iter(tails.values())) if len(heads) == 1 else _halves(heads, tails)
        return f"(?:{body})?" if "" in at else body

    return f"(?=({of(tree)}))"


def _halves(heads: list[str], tails: dict[str, str]) -> str:
    """Alternatives by their first letters, which are halved until few are left."""
    if len(heads) <= 3:
        return "(?:" + "|".join(tails[c] for c in heads) + ")"
    cut = len(heads) // 2
    a, b = heads[:cut], heads[cut:]
    first = lambda x: "[" + "".join(re.escape(c) for c in x) + "]"
    return f"(?:(?={first(a)}){_halves(a, tails)}|(?={first(b)}){_halves(b, tails)})"


def candidates(docs: DataFrame, patterns: list[Pattern], dialect: str = "local", prefilter: bool = True) -> DataFrame:
    """Every match of every pattern as a candidate row, with context and the pattern's columns.

    ``docs`` has ``source_url, content``; a null content is no text and gives nothing.
    Other columns of ``docs`` are dropped.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    if not patterns:
        raise ValueError("no patterns to scan with")
    rows = docs.select("source_url", "content")
    ids = candidate_ids(patterns, F.col("content")) if prefilter else F.array(*[F.lit(i) for i in range(len(patterns))])
    # Conditions on the text are part of the generator. A filter would go below a shuffle that deals the rows out, and make the texts there as well.
    wanted = F.col("content").isNotNull()
    if dialect == "remote":
        wanted = wanted & ~F.rlike(F.lower(F.coalesce("source_url", F.lit(""))), F.lit(SKIPPED_SUFFIXES))
    if len(patterns) == 1:
        wanted = wanted & F.rlike("content", F.lit(java_regex(patterns[0])))
    near = rows.withColumn("id", F.explode(F.when(wanted, ids)))
    # All that needs a long text is worked out before the matches become rows, so no row carries it further.
    lines, kept = dialect != "remote", ["content"] if dialect == "matches" else []
    if len(patterns) <= COMPILED:
        near = near.withColumns({"vals": F.expr(_values(patterns, dialect)), "short": (F.octet_length("content") <= H.SHORT) & F.is_valid_utf8("content")})
        bare = F.transform("vals", lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("window"), F.lit(None).cast("int").alias("line")))
        at = F.when(F.col("short"), bare).otherwise(H.located(F.col("content"), F.col("vals"), lines))
        found = near.select("source_url", "id", F.when(F.col("short"), F.col("content")).alias("text"), F.explode(at).alias("at"), *kept)
        found = found.select("source_url", "id", "text", "at.*", *kept).withColumn("before", F.call_function("substring_index", "text", "value", F.lit(1)))
        window, line = H.place(F.col("text"), F.col("value"), F.col("before"), lines)
        found = found.withColumns({"window": F.when(F.col("text").isNull(), F.col("window")).otherwise(window), "line": F.when(F.col("text").isNull(), F.col("line")).otherwise(line)})
    else:
        found = near.select("source_url", "id", F.explode(H.located(F.col("content"), F.expr(_values(patterns, dialect)), lines)).alias("at"), *kept).select("source_url", "id", "at.*", *kept)
    found = found.select("source_url", "id", "value", "window", "line", F.col("content" if dialect == "matches" else "window").alias("context"))
    n = F.octet_length("value")
    outside = H.has_code_pattern(F.col("value")) | H.is_file_path(F.col("value")) | H.is_content_type(F.col("value"))
    if dialect == "remote":
        found = found.where(n.between(5, 200) & ~outside)
    if dialect == "matches":
        found = found.where(n.between(4, 500) & ~outside & ~any_in(F.col("value"), UNWANTED))
    catalog = docs.sparkSession.createDataFrame(prepared(patterns), CATALOG).drop("p_regex")
    return found.join(F.broadcast(catalog), "id").withColumnRenamed("id", "p_id")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(patterns: list[Pattern], dialect: str) -> str:
    """SQL of the values that pattern ``id`` gives in ``content``, in one pass of its regex where groups allow.

    Each regex is a literal of its own branch, and so is compiled once in a task.
    """
    branches = []
    for i, p in enumerate(patterns):
        regex = _literal(java_regex(p))
        group, whole = f"regexp_extract_all(content, {regex}, 1)", f"regexp_extract_all(content, {regex}, 0)"
        if dialect == "matches":
            own = f"array_distinct(concat(filter({group}, x -> x <> ''), {whole}))"
        elif groups(p.regex):
            own = f"element_at(transform(array({group}), g -> if(exists(g, x -> x = ''), zip_with({whole}, g, (w, x) -> if(x <> '', x, w)), g)), 1)"
        else:
            own = group
        branches.append(f"WHEN {i} THEN {own}")

    def among(i: int, j: int) -> str:
        """Halves the ids until few are left: tried one by one, hundreds of branches take longer than the regex."""
        if j - i <= 4:
            return f"CASE id {' '.join(branches[i:j])} END"
        k = (i + j) // 2
        return f"IF(id < {k}, {among(i, k)}, {among(k, j)})"

    return among(0, len(branches))


def score_candidates(docs: DataFrame, patterns: list[Pattern], dialect: str = "local", prefilter: bool = True) -> DataFrame:
    """Candidates with ``guard, confidence, valid, accepted`` and the score's terms; rejected ones included."""
    names = [x.split()[0] for x in CATALOG.split(", ")]
    known = [dict(zip(names, row, strict=True)) for row in prepared(patterns)]
    rows = evaluate(candidates(docs, patterns, dialect, prefilter), dialect != "remote", known)
    accepted = F.col("valid") & (F.col("confidence") >= 0.5) if dialect == "local" else F.col("valid")
    return rows.withColumn("accepted", accepted).withColumn("context", F.col("window")).drop("window")


def scan(docs: DataFrame, patterns: list[Pattern], dialect: str = "local", prefilter: bool = True) -> DataFrame:
    """Accepted findings, one row per match (in the matches dialect: per distinct value of a pattern).

    Returns ``type, risk, value, source_url, context, line, confidence, description``;
    only the local dialect has descriptions.
    """
    rows = score_candidates(docs, patterns, dialect, prefilter).where("accepted")
    description = F.col("p_description") if dialect == "local" else F.lit("")
    return rows.select("type", F.col("p_risk").alias("risk"), "value", "source_url", "context", "line", "confidence", description.alias("description"))


def scan_distinct(docs: DataFrame, patterns: list[Pattern], dialect: str = "local") -> DataFrame:
    """As ``scan``, but equal contents are scanned once and the findings joined back to all their sources.

    Sources and hashes alone find the first source of a hash, which stands for it. The
    texts of those sources are picked by a join on (source, hash), a key that no group
    of copies shares. The findings then meet all sources on the hash; both sides of that
    join are dealt out anew, so adaptive execution can split a hash that many share.
    """
    keyed = docs.select("source_url", "content").where("content is not null").withColumn("key", F.sha2("content", 256))
    if dialect == "remote":
        keyed = keyed.where(~F.rlike(F.lower(F.coalesce("source_url", F.lit(""))), F.lit(SKIPPED_SUFFIXES)))
    names = F.coalesce("source_url", F.lit(""))
    first = keyed.groupBy("key").agg(F.min(names).alias("name"))
    picked = keyed.withColumn("name", names).join(first, ["key", "name"], "left_semi").dropDuplicates(["key", "name"])
    found = scan(picked.select(F.col("key").alias("source_url"), "content"), patterns, dialect).withColumnRenamed("source_url", "key")
    return found.join(keyed.select("key", "source_url"), "key").select(*FINDING)
