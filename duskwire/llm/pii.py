"""Personal data: exact base patterns, and bootstrapped contextual extraction beyond them.

What the base patterns match are seed entities. The words to the left of a seed induce
lexical patterns (the last word, and the last two). Patterns and the instances they
precede form a graph; a pattern's confidence is the mean confidence of its distinct
instances, an unseeded instance's is the largest of its patterns', and a few rounds
of this settle both. Patterns of high confidence then mark identifiers that no base
pattern knows, if they have the makings of the kind. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwire.llm.common import broadcast_if_small, staged

KINDS = ["email", "ip", "card", "phone"]
_E = r"[A-Za-z0-9._%+-]"
#: As the plain patterns match, but linear on long runs: a match begins where a run does or the last match ended.
PATTERNS = {
    "email": rf"(?:(?<!{_E})|\G){_E}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Whole tokens with a digit or an @, with the digit groups that follow after single spaces: what an unseen identifier looks like.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20\(?[0-9][0-9().-]*+(?![^\x20\x09-\x0D,;:!?]))*+"
#: What a discovered identifier of a kind must have: its shape, and the fewest and most digits.
MAKINGS = {"email": ("@", 0, 64), "ip": (r"^[0-9A-Fa-f]+(?:[.:][0-9A-Fa-f]*){2,}$", 2, 32), "card": ("[0-9]", 12, 19), "phone": ("[0-9]", 7, 15)}
#: Code points of a piece that a text is cut into before spans are replaced.
PIECE = 4096
LEFT_CHARS = 80
#: Rounds over the graph; a pattern is sure from this confidence and so many distinct seeds on.
ROUNDS, CONFIDENT, SUPPORT = 3, 0.8, 3
SITE = "array<struct<start:int,end:int,value:string,left:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often body's lambdas run."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _before(lengths: Column, blocks: Column, i: Column) -> Column:
    """Sum of the first ``i`` lengths; ``blocks`` are the sums of the 128s."""
    b = F.floor(i / 128).cast("int")
    return _sum(F.slice(blocks, F.lit(1), b)) + _sum(F.slice(lengths, b * 128 + 1, i - b * 128))


def sites(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points and what stands to their left."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cell = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("value"), F.right(p, F.lit(LEFT_CHARS)).alias("left")))

    def place(c):
        lengths = F.transform(c, lambda x: x["gap"] + F.coalesce(x["len"], F.lit(0)))

        def inner(s):
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 128).cast("int")), lambda k: _sum(F.slice(s, k * 128 + 1, F.lit(128))))
            return _let(
                blocks,
                lambda b: F.transform(c, lambda x, i: _let(_before(s, b, i) + x["gap"], lambda at: F.struct(at.alias("start"), (at + x["len"]).alias("end"), x["value"].alias("value"), x["left"].alias("left")))),
            )

        return F.filter(_let(lengths, inner), lambda x: x["value"].isNotNull())

    return _let(cell, place)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(d), ""), lambda x, i: _let(x.cast("int") * (1 + i % 2), lambda y: F.when(y > 9, y - 9).otherwise(y))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return ~F.exists(part, lambda p: (F.length(p) > 3) | (F.coalesce(p.try_cast("int"), F.lit(0)) > 255))
    if kind == "card":
        return _let(_digits(v), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _valid_site(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, its valid matches in ``text``: failing ones are dropped, without another try inside them."""
    out = {}
    for kind in KINDS:
        there = F.rlike(text, F.lit("[0-9]")) if kind != "email" else F.lit(True)
        if NEEDS[kind]:
            there = F.contains(text, F.lit(NEEDS[kind])) & there
        out[kind] = F.when(there, F.filter(sites(text, PATTERNS[kind]), _valid_site(kind))).otherwise(F.array().cast(SITE))
    return out


def _spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _first_pass(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and unseen tokens of every row, without the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = base_spans(F.col("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"), text.alias("text"))
    tokens = F.when(F.rlike("text", F.lit("[0-9@]")), F.filter(sites(F.col("text"), TOKEN), lambda s: _identifier(s["value"]))).otherwise(F.array().cast(SITE))
    return rows.select("doc_id", "copy", *[c.alias(k) for k, c in spans.items()], tokens.alias("token"))


def _core(v: Column) -> Column:
    """A token without the punctuation around it."""
    return F.regexp_replace(v, r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")


def _identifier(v: Column) -> Column:
    return (F.length(_digits(v)) >= 4) | (F.contains(v, F.lit("@")) & (F.length(v) >= 6))


def _plausible(k: Column, v: Column) -> Column:
    """Whether a token has the makings of kind number ``k``."""
    out = F.lit(False)
    for i, kind in enumerate(KINDS):
        shape, least, most = MAKINGS[kind]
        out = F.when(k == i, F.rlike(v, F.lit(shape)) & F.length(_digits(v)).between(least, most)).otherwise(out)
    return out


def _contexts(left: Column) -> Column:
    """Lexical patterns of what stands to the left: its last word and its last two; those with digits induce none."""
    w = F.array_remove(F.split(F.lower(left), r"[\x20\x09-\x0D]+"), "")
    return _let(w, lambda a: F.filter(F.array(F.when(F.size(a) >= 1, F.element_at(F.slice(a, -1, 1), 1)), F.when(F.size(a) >= 2, F.array_join(F.slice(a, -2, 2), " "))), lambda p: p.isNotNull() & ~F.rlike(p, F.lit("[0-9@]"))))


def score_patterns(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """``pattern, kind, confidence, seeds`` after ``rounds`` over the graph of ``edges(pattern, value)``.

    ``seeds(value, kind)`` have confidence 1. A pattern's confidence for a kind is
    the sum over its distinct values, divided by one more than their number; an
    unseeded value's is the largest that its patterns give it. Patterns with fewer
    than ``support`` seeds of a kind take no part in it.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    links = edges.join(seeds, "value").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support).join(sizes, "pattern")
    links = links.checkpoint()
    open_ = edges.join(seeds.select("value").distinct(), "value", "left_anti").join(links.select("pattern").distinct(), "pattern", "left_semi").checkpoint()
    scored = links.withColumn("confidence", F.col("seeds") / (F.col("n") + 1))
    for _ in range(rounds - 1):
        values = open_.join(scored, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("c"))
        more = open_.join(values, "value").groupBy("pattern", "kind").agg(F.sum("c").alias("more"))
        scored = links.join(more, ["pattern", "kind"], "left").withColumn("confidence", (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + 1)).drop("more").checkpoint()
    return scored.select("pattern", "kind", "confidence", "seeds")


def discovered(first: DataFrame, confident: float = CONFIDENT, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, copy, k, start, end``: identifiers that sure patterns mark, that have the makings of the kind, and that no base span overlaps."""
    base = None
    for k, kind in enumerate(KINDS):
        part = first.select("doc_id", "copy", F.lit(k).alias("k"), F.explode(kind).alias("s"))
        base = part if base is None else base.unionByName(part)
    base = base.select("doc_id", "copy", "k", "s.start", "s.end", F.lower("s.value").alias("value"), "s.left")
    token = first.select("doc_id", "copy", F.explode("token").alias("s")).select("doc_id", "copy", (F.col("s.start") + F.length(F.regexp_extract("s.value", r"^[^\p{L}\p{N}+]*", 0))).alias("start"), _core(F.col("s.value")).alias("raw"), "s.left")
    token = token.select("doc_id", "copy", "start", (F.col("start") + F.length("raw")).alias("end"), F.lower("raw").alias("value"), "left").where(_identifier(F.col("value")))
    linked = lambda d: d.select("value", F.explode(_contexts(F.col("left"))).alias("pattern"))
    edges = linked(base).unionByName(linked(token)).distinct()
    seeds = base.select("value", F.col("k").alias("kind")).distinct()
    sure = score_patterns(edges, seeds, rounds, support).where(F.col("confidence") >= confident)
    marked = token.withColumn("pattern", F.explode(_contexts(F.col("left")))).join(sure, "pattern").where(_plausible(F.col("kind"), F.col("value")))
    best = marked.groupBy("doc_id", "copy", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("m")).select("doc_id", "copy", (-F.col("m.k")).alias("k"), "start", "end")
    b = base.select(F.col("doc_id").alias("bd"), F.col("copy").alias("bc"), F.col("start").alias("bs"), F.col("end").alias("be"))
    over = best.doc_id.eqNullSafe(b.bd) & best.copy.eqNullSafe(b.bc) & (best.start < b.be) & (b.bs < best.end)
    return best.join(b, over, "left_anti")


def _keyed(k: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Spans of personal data in every whole text, row for row.

    A null text counts as empty and an empty text has no spans; null ids and repeated
    rows are kept as they are; other columns are ignored; an empty table gives no
    rows. Base spans of different kinds may overlap each other; discovered ones
    overlap no base span.

    Returns ``doc_id, copy, base, spans``: ``copy`` is a hash of the text, the others
    arrays of (start, k, end), k the kind's number, in code points, end exclusive.
    """
    first = staged(_first_pass(docs, id_col, text_col), "first_pass")
    base = F.array_sort(F.concat(*[F.transform(kind, _keyed(k)) for k, kind in enumerate(KINDS)]))
    rows = first.select("doc_id", "copy", base.alias("base"))
    added = discovered(first, **options).groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "k", "end")).alias("added"))
    a = added.select(F.col("doc_id").alias("ad"), F.col("copy").alias("ac"), "added")
    both = rows.join(a, rows.doc_id.eqNullSafe(a.ad) & rows.copy.eqNullSafe(a.ac), "left")
    return both.select("doc_id", "copy", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    found = find_pii(docs)
    n = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[n(k) for k in range(4)], F.sha2(_spans_text(F.col("base")), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, as ``[EMAIL]``.

    Overlapping spans become one, named by the first. Texts without spans, null texts
    and all other columns stay as they are; rows stay one for one.
    """
    found = staged(find_pii(docs, id_col, text_col, **options).where(F.size("spans") > 0).select(F.col("doc_id").alias("fd"), F.col("copy").alias("fc"), "spans").distinct(), "spans")
    f = broadcast_if_small(staged(_merged(found), "cuts"))
    both = docs.join(f, docs[id_col].eqNullSafe(f.fd) & F.xxhash64(docs[text_col]).eqNullSafe(f.fc), "left")
    text, cuts = docs[text_col], f["cuts"]
    return both.select(*[(F.when(cuts.isNull(), text).otherwise(_replaced(text, cuts)).alias(c) if c == text_col else docs[c]) for c in docs.columns])


def _merged(found: DataFrame) -> DataFrame:
    """``fd, fc, cuts``: spans that overlap made one, named by the first. Spans are rows here and no text is, so a text of many costs in proportion."""
    order = Window.partitionBy("fd", "fc").orderBy("start", "k", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.select("fd", "fc", F.explode("spans").alias("s")).select("fd", "fc", "s.*").withColumn("new", F.when(F.col("start") < upto, 0).otherwise(1))
    rows = rows.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = rows.groupBy("fd", "fc", "nth").agg(F.min(F.struct("start", "k")).alias("first"), F.max("end").alias("end"))
    return one.groupBy("fd", "fc").agg(F.array_sort(F.collect_list(F.struct("first.start", "first.k", "end"))).alias("cuts"))


def _replaced(text: Column, cuts: Column) -> Column:
    """``text`` with each cut's kind in brackets in its place; pieces of ``PIECE`` code points are looked into and never the text from its start."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put(pieces):
        def part(start, end):
            first = F.floor(start / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(some, start % PIECE + 1, end - start)).otherwise("")

        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"])
        kept = F.transform(cuts, lambda c, i: _let(before(i), lambda p: F.concat(part(p, c["start"]), F.element_at(names, c["k"] + 1))))
        return F.concat(F.array_join(kept, ""), part(F.element_at(cuts, -1)["end"], F.char_length(text)))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), put)
