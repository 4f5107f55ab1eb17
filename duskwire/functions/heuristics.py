"""Heuristics on a candidate value and its context, as Spark columns.

Lengths are bytes. Each function takes columns and gives a boolean or double column;
nothing here runs Python on rows.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


# The words and marks that the heuristics look for.
PATH_PARTS = [".", "node_modules", "dist", "src", "modules"]
CONTENT_TYPES = ["application/", "text/", "image/", "audio/", "video/", "multipart/", "charset=", "content-type"]
CODE_WORDS = ["function", "return", "const ", "var ", "let ", "import ", "export ", "require(", "module.", "class ", "interface ", "typeof ", "console.", "window.", "document."]
TRANSLATION = [
    "_text", "_msg", "_message", "_label", "_title", "_description", "_error", "_info", "_hint", "_help", "_tooltip", "_placeholder", "_button", "_link", "_heading", "_flash", "_notification",
    "_trend", "_chart", "_enabled", "_disabled", "_by_", "_and_",
]
I18N = [
    "message_", "label_", "error_", "success_", "button_", "placeholder_", "tooltip_", "hint_", "alert_", "text_", "title_", "description_", "header_", "footer_", "nav_", "min_", "max_", "app_",
    "page_", "dialog_", "login.", "freshchat_", "ui_", "validation_",
]
MINI_MARKS = ["++", "--", "==", "===", "!=", "!==", "+=", "-=", "*=", "/=", ".push(", ".pop(", ".shift(", ".map(", ".filter(", ".forEach(", "function(", "return ", ";var ", ";let ", ";const ", "&&", "||"]
OPERATORS = ["++", "--", "+=", "-=", "*=", "/=", "==", "===", "!=", "!==", ">=", "<=", "&&", "||", ">>", "<<", ">>>", "<<="]
MINI_BLOCKS = [";var ", ";let ", ";const ", ";function", "function(", "return ", "+function", "}(", "({", "})", ":[", ",function", "=[", "={", "=function"]
CSS = ["-background-", "-color", "-radius", "-distance", "-shadow", "-border-", "-margin-", "-padding-", "-font-", "-size-", "-hover", "-active", "-focus", "-selected", "-disabled"]
DOC_WORDS = ["example", "usage", "documentation", "wiki", "github.com", "http://", "https://", "/docs/", "/documentation/", "@example", "@caption", "@see", "@link", "sample", "tutorial"]
VERBS = [
    "get", "set", "update", "delete", "create", "find", "fetch", "compute", "calculate", "validate", "parse", "format", "convert", "transform", "handle", "process", "initialize", "start", "stop",
    "transition", "register", "unregister", "subscribe", "unsubscribe",
]
URLS = [".com/", ".io/", ".net/", ".org/", ".edu/", ".gov/", "/api/", "/docs/", "/sdk/", "/plugins/", "/wiki/", "github.com", "gitlab.com", "bitbucket.org", "stackoverflow.com"]
JS_VERBS = [
    "get", "set", "update", "create", "delete", "remove", "handle", "process", "parse", "format", "convert", "validate", "verify", "check", "is", "has", "can", "should", "will", "did", "fetch", "load",
    "save", "store", "cache", "transition", "transform", "enable", "disable", "toggle", "show", "hide", "open", "close", "start", "stop", "begin", "end", "init", "setup", "enroll", "authenticate",
    "authorize", "login", "logout", "register", "subscribe", "unsubscribe", "connect", "disconnect", "mount", "unmount", "render", "display",
]
COMPONENTS = ["component", "element", "handler", "listener", "callback", "effect", "reducer", "action", "selector", "container", "provider", "consumer", "context", "fragment", "memo", "ref"]
EVENTS = ["Mount", "Unmount", "Update", "Change", "Click", "Submit", "Focus", "Blur", "KeyDown", "KeyUp", "MouseOver", "MouseOut", "TouchStart", "TouchEnd", "Drag", "Drop", "Resize", "Scroll"]
AUTH = [
    "MFA", "2FA", "TwoFactor", "MultiFactorAuth", "AuthFactor", "Verify", "Validate", "Authenticate", "Authorize", "Token", "Credential", "Password", "Login", "Logout", "Session", "Remember", "Forgot",
    "Reset", "Change", "Update", "Check",
]
CONSTANTS = [
    "DEFAULT_", "MAX_", "MIN_", "REQUIRED_", "OPTIONAL_", "CONFIG_", "TYPE_", "MODE_", "STATE_", "STATUS_", "EVENT_", "ACTION_", "ERROR_", "SUCCESS_", "WARNING_", "INFO_", "DEBUG_", "LOG_", "AUTH_",
    "USER_", "ADMIN_", "CLIENT_", "SERVER_", "APP_", "PERMISSION_", "ROLE_", "FEATURE_", "FLAG_", "TOGGLE_",
]
PLACEHOLDER_PREFIXES = ["email@", "name@", "test@", "example@", "first.last@"]
PLACEHOLDER_DOMAINS = ["@example.com", "@test.com", "@domain.com", "@email.com"]
ASSIGNMENT = r"(?i)(api|token|secret|password|key|auth|credential)[^\n\r]{0,20}[:=]"
#: What the assignment must hold, and the same expression with the first letters looked at first.
ASSIGNED = ["api", "token", "secret", "password", "key", "auth", "credential"]
ASSIGNMENT_FAST = r"(?i)(?=[atspkc])(?:api|token|secret|password|key|auth|credential)[^\n\r]{0,20}[:=]"
SIGNALS = ["apikey", "api_key", "token", "secret", "password", "credential", "auth", "access"]


def _list(terms) -> Column:
    """A constant array, folded before anything runs."""
    return F.split(F.lit("\x01".join(terms)), "\x01")


def _quoted(terms) -> str:
    return "(?:" + "|".join(re.escape(t) for t in terms) + ")"


def any_in(text: Column, terms) -> Column:
    """Whether the text holds any of the terms. Searches for plain strings are much cheaper than an alternation tried at each place.

    A term that holds another one adds nothing; three or more that share a mark are looked for in texts with that mark only."""
    terms = list(dict.fromkeys(terms))
    left = [t for t in terms if not any(x != t and x in t for x in terms)]
    parts = []
    for mark in sorted({c for t in left for c in t if not c.isalnum()}, key=lambda c: (-sum(c in t for t in left), c)):
        own = [t for t in left if mark in t]
        if len(own) > 2:
            left = [t for t in left if mark not in t]
            parts.append(F.contains(text, F.lit(mark)) & reduce(or_, [F.contains(text, F.lit(t)) for t in own]))
    return reduce(or_, [F.contains(text, F.lit(t)) for t in left] + parts)


def count_in(text: Column, terms) -> Column:
    """How many of the terms the text holds."""
    return reduce(add, [F.coalesce(F.contains(text, F.lit(t)), F.lit(False)).cast("int") for t in terms])


def starts_any(text: Column, terms) -> Column:
    return F.rlike(text, F.lit("^" + _quoted(terms)))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences."""
    return F.floor((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))) / len(term.encode()))


def is_file_path(v: Column) -> Column:
    return any_in(v, ["\\", "/"]) & any_in(v, PATH_PARTS)


def is_content_type(v: Column, low: Column | None = None) -> Column:
    """``low``, here and below, is the lower-case value if it is at hand."""
    return any_in(F.lower(v) if low is None else low, CONTENT_TYPES)


def has_code_pattern(v: Column) -> Column:
    return any_in(v, CODE_WORDS)


def is_translation_key(v: Column, low: Column | None = None) -> Column:
    """Each of the terms has an underscore, so a value without one is spared the search."""
    return (F.contains(v, F.lit("_")) & (any_in(F.lower(v) if low is None else low, TRANSLATION) | (occurrences(v, "_") >= 3))) | (F.contains(v, F.lit(".")) & (occurrences(v, ".") >= 2))


def is_i18n_key(v: Column, low: Column | None = None) -> Column:
    return ((F.octet_length(v) > 20) & F.contains(v, F.lit("_")) & (occurrences(v, "_") >= 2)) | starts_any(F.lower(v) if low is None else low, I18N)


#: Any of the marks, blocks and operators that the next two functions count begins or lies in one of these.
BUSY = r"(?=[-+*/=!<>&|}(:;,fr.])(?:[-+*/=!<>&|][-+=<>&|]|\}[()]|\(\{|[:=]\[|=\{|function|return |;(?:var|let|const) |\.(?:push|pop|shift|map|filter|forEach)\()"


def is_busy(c: Column) -> Column:
    """False only of a text without any of ``MINI_MARKS``, ``MINI_BLOCKS`` and ``OPERATORS``: one pass spares it the counts."""
    return F.rlike(c, F.lit(BUSY))


def is_pattern_in_minified(v: Column, c: Column, busy: Column | None = None) -> Column:
    shapes = r"[a-z]\.[a-z]\.[a-z]|[a-z]\([a-z],[a-z]\)|var [a-z]=[^;]+,[a-z]="
    busy = is_busy(c) if busy is None else busy
    return (busy & (count_in(c, MINI_MARKS) >= 3)) | (any_in(c, [".", "(", "var "]) & F.rlike(c, F.lit(shapes))) | F.rlike(v, F.lit(r"^[A-Za-z][0-9][A-Za-z][0-9]|[a-z][A-Z][0-9][a-z][A-Z]"))


def is_in_minified(c: Column, busy: Column | None = None) -> Column:
    n = F.octet_length(c)
    operators = F.aggregate(_list(OPERATORS), F.lit(0.0), lambda a, op: a + (n - F.octet_length(F.replace(c, op, F.lit("")))) / F.octet_length(op))
    busy = is_busy(c) if busy is None else busy
    return ((F.octet_length(c) > 100) & (occurrences(c, "\n") < 3)) | (busy & ((operators > 5) | (count_in(c, MINI_BLOCKS) >= 3)))


def is_css(v: Column) -> Column:
    return F.startswith(v, F.lit("--")) | any_in(v, CSS)


def is_uuid(v: Column) -> Column:
    return F.rlike(v, F.lit(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"))


def distinct_characters(v: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(v, "")), "")


def _shares(v: Column, distinct: Column | None = None) -> Column:
    """Share of each distinct character in the characters, in order of their first places.

    Bytes of a character over those that as many characters of its size have: the same
    quotient, and bytes needn't be counted."""
    n = F.char_length(v)
    return F.transform(distinct_characters(v) if distinct is None else distinct, lambda c: (F.octet_length(v) - F.octet_length(F.replace(v, c, F.lit("")))) / (F.octet_length(c) * n))


def has_repeats(v: Column) -> Column:
    """From 20 bytes on: six equal characters in a row; or from 30 on at most five different ones, one over three tenths of the bytes."""
    counts = F.transform(distinct_characters(v), lambda c: (F.char_length(v) - F.char_length(F.replace(v, c, F.lit("")))).cast("double"))
    few = (F.octet_length(v) >= 30) & (F.size(distinct_characters(v)) <= 5) & F.exists(counts, lambda n: n / F.octet_length(v) > 0.3)
    return (F.octet_length(v) >= 20) & (F.rlike(v, F.lit(r"(?s)(.)\1{5}")) | few)


def is_documentation(v: Column, c: Column | None = None, low: Column | None = None) -> Column:
    own = any_in(F.lower(v) if low is None else low, DOC_WORDS)
    return own if c is None else own | any_in(F.lower(c), DOC_WORDS)


CAMEL = r"^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\z"
def is_function_name(v: Column, low: Column | None = None) -> Column:
    return F.rlike(v, F.lit(CAMEL)) | starts_any(F.lower(v) if low is None else low, VERBS)


def is_url(v: Column) -> Column:
    return any_in(v, URLS)


def is_js_function(v: Column, low: Column | None = None) -> Column:
    """Camel case with a leading verb or a component's event; or a verb and a word of authentication run together, in any case."""
    event = f"(?:{'|'.join(COMPONENTS)}|Did|Will|On|After|Before)(?:{'|'.join(EVENTS)})"
    camel = F.rlike(v, F.lit(CAMEL)) & (starts_any(F.lower(v) if low is None else low, JS_VERBS) | F.rlike(v, F.lit(event)))
    words = "|".join(AUTH)
    # The look-ahead names the first letters: most places are passed over by one test.
    joined = f"(?i)(?=[tvedihcsw])(?:(?:transition|verify|enable|display|is|has|can)[A-Z][a-zA-Z]*(?:{words})|(?:is|has|can|should|will|did)(?:{words})[A-Z])"
    return camel | F.rlike(v, F.lit(joined))


def is_js_constant(v: Column) -> Column:
    return F.rlike(v, F.lit(r"^[A-Z][A-Z0-9_]*\z")) | starts_any(v, CONSTANTS)


def entropy(v: Column, distinct: Column | None = None) -> Column:
    """Shannon bits per character."""
    return F.aggregate(_shares(v, distinct), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def entropy_bounds(v: Column, distinct: Column) -> tuple[Column, Column]:
    """The least and the most that ``entropy`` can be with ``distinct`` different characters: all but one of them occur
    once, or all equally often. Where bounds decide, no character needs to be counted."""
    m = F.greatest(F.char_length(v), F.lit(1)).cast("double")
    d = F.greatest(distinct, F.lit(1)).cast("double")
    q = F.floor(m / d).cast("double")
    r = m - q * d
    part = lambda k, times: times * (k / m) * F.log2(k / m)
    return -(part(m - d + 1, F.lit(1.0)) + part(F.lit(1.0), d - 1)), -(part(q + 1, r) + part(q, d - r))


def char_classes(v: Column) -> Column:
    """How many of lower, upper, digit and other occur."""
    return sum((F.rlike(v, F.lit(c)).cast("int") for c in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[^\p{Ll}\p{Lu}\p{Nd}]")), F.lit(0))


def is_random_secret(v: Column, bits: Column, least: Column, h: Column, low: Column | None = None) -> Column:
    """``h`` is the value's entropy, passed in so that it is worked out once."""
    odd = is_css(v) | is_i18n_key(v, low) | is_function_name(v, low) | is_url(v) | is_documentation(v, low=low) | has_repeats(v) | is_uuid(v)
    return (F.octet_length(v) >= least) & ~odd & (char_classes(v) >= 2) & (h >= bits)


def is_placeholder_email(v: Column, low: Column | None = None) -> Column:
    low = F.lower(v) if low is None else low
    return starts_any(low, PLACEHOLDER_PREFIXES) | F.rlike(low, F.lit(_quoted(PLACEHOLDER_DOMAINS) + r"\z"))


def context_window(content: Column, value: Column, radius: int = 100) -> Column:
    """``radius`` bytes on either side of the value's first occurrence; a character may be cut."""
    raw = F.encode(content, "UTF-8")
    at = F.octet_length(F.call_function("substring_index", content, value, F.lit(1)))
    start = F.greatest(at - radius, F.lit(0))
    size = at + F.octet_length(value) + radius - start
    return F.when(F.contains(content, value), F.substring(raw, start + 1, size).cast("string")).otherwise("")


#: Bytes up to which a text is searched byte by byte.
SHORT = 2000


def located(content: Column, values: Column, lines: bool, radius: int = 100) -> Column:
    """``value, window, line`` of each of ``values``, as ``context_window`` and ``line_number`` give them for values
    that the text holds. The text is encoded once; each value is looked for once, by a literal split, which skips
    through the text where the plain string functions compare at every byte. Without ``lines`` the line is 0."""

    def each(raw):
        short = (F.octet_length(raw) <= SHORT) & (raw == content.cast("binary"))

        def one(v):
            quoted = F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
            # A short text is searched sooner than such an expression is compiled.
            before = F.when(short, F.call_function("substring_index", content, v, F.lit(1))).when(v == "", F.lit("")).otherwise(F.get(F.split(content, quoted, 2), F.lit(0)))

            def at_place(before):
                at = F.octet_length(before)
                start = F.greatest(at - radius, F.lit(0))
                window = F.substring(raw, start + 1, at + F.octet_length(v) + radius - start).cast("string")
                line = F.when(F.contains(v, F.lit("\n")), 0).when(F.contains(before, F.lit("\n")), F.size(F.split(before, "\n", -1))).otherwise(1) if lines else F.lit(0)
                return F.struct(v.alias("value"), window.alias("window"), line.alias("line"))

            return F.element_at(F.transform(F.array(before), at_place), 1)

        return F.transform(values, one)

    return F.element_at(F.transform(F.array(F.encode(content, "UTF-8")), each), 1)


def place(content: Column, value: Column, before: Column, lines: bool, radius: int = 100) -> tuple[Column, Column]:
    """Window and line as ``located`` gives them, of a text of valid UTF-8, ``before`` being what precedes the value."""
    at = F.octet_length(before)
    start = F.greatest(at - radius, F.lit(0))
    window = F.substring(content.cast("binary"), start + 1, at + F.octet_length(value) + radius - start).cast("string")
    feeds = F.when(F.contains(before, F.lit("\n")), at - F.octet_length(F.replace(before, F.lit("\n"), F.lit("")))).otherwise(0)
    return window, F.when(F.contains(value, F.lit("\n")), 0).otherwise(feeds + 1) if lines else F.lit(0)


def line_number(content: Column, value: Column) -> Column:
    """The first line that holds the value, from 1; 0 if none does, as when the value spans lines."""
    before = F.call_function("substring_index", content, value, F.lit(1))
    return F.when(F.contains(value, F.lit("\n")) | ~F.contains(content, value), F.lit(0)).otherwise((occurrences(before, "\n") + 1).cast("int"))


def is_binary(raw: Column) -> Column:
    """More than a tenth of the first 512 bytes are NUL or controls other than line feed, return and tab; an empty file is text."""
    digits = F.hex(F.substring(raw, 1, 512))
    n = F.length(digits) / 2
    odd = F.size(F.filter(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), lambda b: (b < "20") & ~b.isin("09", "0A", "0D")))
    return (n > 0) & (odd / n > 0.1)
