"""The pattern catalog: built-in definitions, custom YAML files, selection and load figures.

Some built-in definitions are adapted from the public secrets-patterns-db rules; see
``duskwire/data/NOTICE``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from duskwire.functions.dialect import groups, required_literals, to_java
from duskwire.functions.risk import risk_of

ROW = (
    "name string, regex string, description string, enabled boolean, category string, minlength int, maxlength int, keywordmatches array<string>, keywordexcludes array<string>, "
    "excluderegexes array<string>, requiredcontextany array<string>, contextboostany array<string>, contextpenaltyany array<string>, useentropy boolean, minentropy double, entropyminlength int"
)


@dataclass(frozen=True)
class Pattern:
    """One definition. Lengths are bytes; a ``maxlength`` of 0 is no limit; a definition that omits ``enabled`` is disabled."""

    name: str
    regex: str = ""
    description: str = ""
    enabled: bool = False
    category: str = ""
    minlength: int = 0
    maxlength: int = 0
    keywordmatches: tuple[str, ...] = ()
    keywordexcludes: tuple[str, ...] = ()
    excluderegexes: tuple[str, ...] = ()
    requiredcontextany: tuple[str, ...] = ()
    contextboostany: tuple[str, ...] = ()
    contextpenaltyany: tuple[str, ...] = ()
    useentropy: bool = False
    minentropy: float = 0.0
    entropyminlength: int = 0

    @property
    def entropy_gate(self) -> tuple[float, int] | None:
        """Bits and least bytes that a value must have, if the pattern asks for entropy."""
        low = self.name.lower()
        if not (self.useentropy or "password" in low or "session_token" in low):
            return None
        return (self.minentropy if self.minentropy > 0 else 3.5, self.entropyminlength if self.entropyminlength > 0 else max(12, self.minlength))

    @property
    def literals(self) -> tuple[str, ...]:
        """Lower-case strings of which a text must hold one to give a finding; empty: nothing is known.

        A required context term is in the context, which is a piece of the text."""
        terms = tuple(t for t in (x.strip().lower() for x in self.requiredcontextany) if t)
        return terms or tuple(sorted(required_literals(self.regex) or ()))


@dataclass(frozen=True)
class LoadStats:
    total: int = 0
    loaded: int = 0
    skipped_by_category: int = 0
    skipped_disabled: int = 0
    failed_validation: int = 0
    failed_compile: int = 0
    failed_exclude: int = 0
    by_category: dict[str, int] = field(default_factory=dict)


def builtin() -> list[Pattern]:
    """The built-in definitions, in name order: those whose shape is their own, and the many
    alike for a service's name next to a key, which ``keyword_pattern`` makes of a table."""
    return sorted(from_yaml(_data("patterns.yaml")) + _services(), key=lambda p: p.name)


def _data(name: str) -> str:
    return resources.files("duskwire").joinpath("data", name).read_text(encoding="utf-8")


def _services() -> list[Pattern]:
    out = []
    for line in _data("keyword.tsv").splitlines():
        if not line.startswith("#"):
            name, category, keyword, need, least, value, description = line.split("\t")
            out.append(keyword_pattern(name, value, keyword, category, description, int(least), need))
    return out


#: Fixed values of a keyword pattern: context that speaks for and against it, and its entropy gate.
KEYWORD_BOOST = ("api", "token", "key")
KEYWORD_PENALTY = ("example", "sample", "placeholder", "test", "docs", "documentation")
KEYWORD_BITS, KEYWORD_BITS_BYTES = 3.6, 24


def keyword_pattern(name: str, value: str, keyword: str | None = None, category: str = "cloud", description: str | None = None, minlength: int | None = None, need: str | None = None) -> Pattern:
    """The rule for a service-scoped key: ``keyword`` (by default the name without its number)
    at most 40 characters before a whole-word match of ``value``, such as ``[0-9a-z]{32}``,
    with ``need``, by default the keyword, required in the context. ``minlength`` is by default the first count in ``value``."""
    stem = re.sub(r"_[0-9]+$", "", name)
    word = stem if keyword is None else keyword
    term = word if need is None else need
    counted = re.search(r"\{([0-9]+)", value)
    least = minlength if minlength is not None else int(counted[1]) if counted else 0
    return Pattern(
        name, rf"(?:{word}).{{0,40}}\b({value})\b", description or f"{stem.replace('_', ' ').capitalize()} API Key", True, category, least, 0, requiredcontextany=(term,),
        contextboostany=(term, *KEYWORD_BOOST), contextpenaltyany=KEYWORD_PENALTY, useentropy=True, minentropy=KEYWORD_BITS, entropyminlength=KEYWORD_BITS_BYTES,
    )


def keyword_patterns(services: Mapping[str, str], category: str = "cloud") -> list[Pattern]:
    """A keyword pattern for each of ``services``, which maps a name to the shape of its key."""
    return [keyword_pattern(name, value, category=category) for name, value in services.items()]


def from_yaml(text: str) -> list[Pattern]:
    """Definitions of a custom file, which replaces the built-in catalog. Unknown keys are ignored, missing ones are empty."""
    import yaml

    found = (yaml.safe_load(text) or {}).get("patterns") or {}
    plain = Pattern.__dataclass_fields__.keys() - {"name"}
    out = []
    for name, spec in found.items():
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in (spec or {}).items() if k in plain and v is not None}
        out.append(Pattern(str(name), **own))
    return sorted(out, key=lambda p: p.name)


def from_file(path: str) -> list[Pattern]:
    with open(path, encoding="utf-8") as f:
        return from_yaml(f.read())


def add_pattern(patterns: Iterable[Pattern], name: str, regex: str, description: str = "") -> list[Pattern]:
    """``patterns`` and one more, of 8 to 500 bytes, in no category."""
    to_java(regex)
    return [*[p for p in patterns if p.name != name], Pattern(name, regex, description, True, "", 8, 500)]


def select(patterns: Iterable[Pattern], include: Iterable[str] = (), exclude: Iterable[str] = (), scan_urls: bool = False) -> tuple[list[Pattern], LoadStats]:
    """The patterns that a scan uses, and what became of the others.

    ``include`` loads the named categories even where disabled; without it enabled
    patterns outside ``exclude`` load. Both together are an error, and so is a
    selection of which nothing compiles. ``scan_urls`` means category ``url`` alone.
    """
    wanted, unwanted = ({"url"}, set()) if scan_urls else ({c.strip().lower() for c in include}, {c.strip().lower() for c in exclude})
    if wanted and unwanted:
        raise ValueError("include and exclude categories can't be used together")
    counts: Counter[str] = Counter()
    by: Counter[str] = Counter()
    loaded = []
    for p in patterns:
        counts["total"] += 1
        category = p.category.lower()
        if wanted and category not in wanted or not wanted and category in unwanted:
            counts["skipped_by_category"] += 1
        elif not wanted and not p.enabled:
            counts["skipped_disabled"] += 1
        elif not p.regex or not p.category:
            counts["failed_validation"] += 1
        elif not _compiles(p.regex):
            counts["failed_compile"] += 1
        else:
            good = tuple(x for x in p.excluderegexes if _compiles(x))
            counts["failed_exclude"] += len(p.excluderegexes) - len(good)
            loaded.append(replace(p, excluderegexes=good))
            by[category] += 1
    tried = counts["total"] - counts["skipped_by_category"] - counts["skipped_disabled"]
    if tried and not loaded:
        raise ValueError("no selected pattern could be loaded")
    return loaded, LoadStats(loaded=len(loaded), by_category=dict(by), **counts)


def _compiles(regex: str) -> bool:
    try:
        re.compile(to_java(regex, check=True))
    except (re.error, ValueError):
        return False
    return True


def catalog_frame(spark: SparkSession, patterns: Iterable[Pattern]) -> DataFrame:
    """The definitions as a table of ``ROW`` columns."""
    names = [x.split()[0] for x in ROW.split(", ")]
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in (getattr(p, n) for n in names)) for p in patterns], ROW)


def risk_frame(spark: SparkSession, patterns: Iterable[Pattern]) -> DataFrame:
    """``name, category, risk`` of every definition, loaded or not."""
    return spark.createDataFrame([(p.name, p.category.lower(), risk_of(p.name, p.category)) for p in patterns], "name string, category string, risk string")


def java_regex(p: Pattern) -> str:
    """The pattern for Spark, with group 1 always there: the whole match where it has none."""
    own = to_java(p.regex)
    return own if groups(p.regex) else f"({own})"
