"""Candidate evaluation: guards in order, then a score summed in a fixed order."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwire.functions import heuristics as H

BASE, LOCAL_BONUS = 0.55, 0.05
#: Entropy that speaks for and against a value of 20 bytes or more, and what sums of doubles may be off by.
HIGH_BITS, LOW_BITS, MARGIN = 3.7, 2.2, 1e-9
THRESHOLD, LOCAL_THRESHOLD = 0.50, 0.45
#: Terms of the score, in the order in which they are added.
TERMS = ["s_entropy", "s_assignment", "s_signal", "s_matches", "s_boost", "s_excludes", "s_penalty", "s_documentation", "s_key", "s_function", "s_constant", "s_minified", "s_special", "s_local"]
#: Guards in the order in which they are tried; the first that fails is the candidate's ``guard``.
GUARDS = ["too_short", "too_long", "excluded", "uuid", "path_or_content_type", "code_pattern", "placeholder_email", "required_context", "entropy"]


#: Terms up to which those of all patterns are written out in one expression.
FEW_TERMS = 100


def _by_terms(patterns: list[dict], column: str, of, otherwise, none) -> Column:
    """``of`` the terms that the pattern of a row has in ``column``; ``none`` if it has none.

    Few terms are literals, which Spark compiles; the other lists stay arrays, for ``otherwise``."""
    lists: dict[tuple, list[int]] = {}
    for p in patterns:
        lists.setdefault(tuple(p[column]), []).append(p["id"])
    lists.pop((), None)
    out, left, rest = None, FEW_TERMS, False
    for terms, ids in sorted(lists.items(), key=lambda x: (-len(x[1]), x[0])):
        left -= len(terms)
        if left < 0 or len(ids) > 500:
            rest = True
            break
        test = F.col("p_id").isin(ids) if len(ids) < len(patterns) else F.lit(True)
        out = F.when(test, of(list(terms))) if out is None else out.when(test, of(list(terms)))
    last = otherwise(F.col(column)) if rest else none
    return last if out is None else out.otherwise(last)


def _hits(patterns: list[dict], column: str, v: Column, c: Column, inside: Column) -> Column:
    """How many terms value or context hold. ``inside``: the context holds the value, and with it all that the value holds."""
    held = lambda t: F.contains(c, t) | (~inside & F.contains(v, t))
    return _by_terms(patterns, column, lambda terms: reduce(add, [held(F.lit(t)).cast("int") for t in terms]), lambda a: F.size(F.filter(a, held)), F.lit(0))


def _boost(name: Column, v: Column) -> Column:
    has = lambda word, *heads: F.contains(name, F.lit(word)) & H.starts_any(v, heads)
    return (
        F.when(has("aws", "AKIA"), 0.22)
        .when(has("google_api", "AIza"), 0.22)
        .when(has("stripe", "sk_live_", "pk_live_"), 0.20)
        .when(has("jwt", "eyJ"), 0.15)
        .when(has("github", "ghp_", "github_pat_"), 0.18)
        .otherwise(0.0)
    )


def _once(rows: DataFrame, made: list[str]) -> DataFrame:
    """``rows``, of which the columns ``made`` are behind a generator.

    A filter on them stays above it, where it would be pushed through plain
    projections and, each column being used by others, copied into the filter many
    times over. What is below the generator is worked out once for each row.
    """
    others = [x for x in rows.columns if x not in made]
    packed = rows.select(*others, F.struct(*made).alias("_packed"))
    return packed.select(*others, F.explode(F.array("_packed")).alias("_made")).select(*others, "_made.*")


def evaluate(candidates: DataFrame, local: bool, patterns: list[dict]) -> DataFrame:
    """Add ``guard, confidence, valid`` (and the terms of the score) to candidates.

    ``candidates`` has ``value, context, p_id`` and its pattern's ``p_*`` columns; ``patterns``
    has the same columns of all patterns, with ``id``. ``guard`` names the first guard that
    fails, whose confidence is 0, and is null for scored candidates. Sums are of doubles,
    from left to right, so that a score on the threshold falls on the right side.

    The steps are projections, which Spark compiles; in a lambda each test would be
    interpreted. What all patterns share is a literal. Lower-case texts, guard and
    entropy are columns that the next step uses several times, and so aren't copied.
    """

    def p(name: str) -> Column:
        values = {x[name] for x in patterns}
        return F.lit(values.pop()) if len(values) == 1 else F.col(name)

    v, c = F.col("value"), F.col("context")
    vl, cl, h, inside, busy, guard, distinct, low, high = (F.col(x) for x in ("value_lower", "context_lower", "h", "inside", "busy", "guard", "distinct", "low", "high"))
    n, gate = F.octet_length("value"), p("p_gated")
    rows = candidates.withColumns({"value_lower": F.lower("value"), "context_lower": F.lower("context")})
    excluded = sorted({r for x in patterns for r in x["p_exclude"]})
    exclusion = reduce(or_, [F.array_contains("p_exclude", F.lit(r)) & (F.rlike(v, F.lit(r)) | F.rlike(c, F.lit(r))) for r in excluded], F.lit(False))
    # A lambda in each long projection keeps it out of Spark's fused methods, which would be too long for the JVM's compiler.
    lacking = (F.size("p_need_raw") > 0) & ~F.exists("p_need", lambda t: F.contains(cl, t))
    early = (
        F.when(n < p("p_minlength"), GUARDS[0])
        .when((p("p_maxlength") > 0) & (n > p("p_maxlength")), GUARDS[1])
        .when(exclusion, GUARDS[2])
        .when(H.is_uuid(v), GUARDS[3])
        .when((p("p_category") != "url") & (H.is_file_path(v) | H.is_content_type(v, vl)), GUARDS[4])
        .when((n < 40) & H.has_code_pattern(v), GUARDS[5])
        .when(F.contains(p("p_lower"), F.lit("email")) & H.is_placeholder_email(v, vl), GUARDS[6])
        .when(lacking, GUARDS[7])
    )
    rows = rows.withColumns({"guard": early, "inside": F.contains(cl, vl), "busy": H.is_busy(c)})
    asked = guard.isNull() & (gate | (n >= 20))
    rows = rows.withColumn("distinct", F.when(asked, H.distinct_characters(v)))
    least, most = H.entropy_bounds(v, F.size("distinct"))
    rows = rows.withColumns({"low": F.when(distinct.isNotNull(), least), "high": F.when(distinct.isNotNull(), most)})
    # The score and the gate ask on which side of their marks the entropy is: often the bounds tell.
    sure = lambda mark: (low > mark + MARGIN) | (high < mark - MARGIN)
    known = F.when(gate, sure(p("p_bits"))).otherwise(sure(F.lit(HIGH_BITS)) & sure(F.lit(LOW_BITS)))
    rows = rows.withColumn("h", F.when(distinct.isNull(), 0.0).when(known, low).otherwise(H.entropy(v, distinct)))
    late = F.when(gate & ~H.is_random_secret(v, p("p_bits"), p("p_least"), h, vl), GUARDS[8])
    rows = rows.withColumn("guard", F.when(guard.isNotNull(), guard).otherwise(late))
    own = lambda hit: hit(cl) | (~inside & hit(vl))
    terms = {
        "s_entropy": F.when(gate, 0.08).when((n >= 20) & (h >= HIGH_BITS), 0.05).when((n >= 20) & (h <= LOW_BITS), -0.10).otherwise(0.0),
        "s_assignment": F.when(H.any_in(c, [":", "="]) & H.any_in(cl, H.ASSIGNED) & F.rlike(c, F.lit(H.ASSIGNMENT_FAST)), 0.12).otherwise(0.0),
        "s_signal": F.when(H.any_in(cl, H.SIGNALS), 0.08).otherwise(0.0),
        "s_matches": F.least(F.lit(0.12), _hits(patterns, "p_matches", vl, cl, inside) * F.lit(0.04)),
        "s_boost": F.least(F.lit(0.15), _hits(patterns, "p_boost", vl, cl, inside) * F.lit(0.05)),
        "s_excludes": -F.least(F.lit(0.30), _hits(patterns, "p_excludes", vl, cl, inside) * F.lit(0.08)),
        "s_penalty": -F.least(F.lit(0.35), _hits(patterns, "p_penalty", vl, cl, inside) * F.lit(0.10)),
        "s_documentation": F.when(own(lambda x: H.any_in(x, H.DOC_WORDS)), -0.22).otherwise(0.0),
        "s_key": F.when(H.is_translation_key(v, vl) | H.is_i18n_key(v, vl), -0.18).otherwise(0.0),
        "s_function": F.when(H.is_function_name(v, vl) | H.is_js_function(v, vl), -0.15).otherwise(0.0),
        "s_constant": F.when(H.is_js_constant(v), -0.10).otherwise(0.0),
        "s_minified": F.when(H.is_in_minified(c, busy) | H.is_pattern_in_minified(v, c, busy), -0.12).otherwise(0.0),
        "s_special": _boost(p("p_lower"), v),
        "s_local": F.lit(LOCAL_BONUS if local else 0.0),
    }
    rows = rows.withColumns({k: F.when(guard.isNull(), t).otherwise(F.lit(0.0)) for k, t in terms.items()})
    rows = _once(rows.drop("value_lower", "context_lower", "h", "inside", "busy", "distinct", "low", "high"), ["guard", *TERMS])
    total = F.lit(BASE)
    for k in TERMS:
        total = total + F.col(k)
    open_, score = F.col("guard").isNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    out = rows.withColumn("confidence", F.when(open_, score).otherwise(F.lit(0.0)))
    return out.withColumn("valid", open_ & (F.col("confidence") >= (LOCAL_THRESHOLD if local else THRESHOLD)))
