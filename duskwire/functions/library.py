"""Further heuristics that no scan uses, as Spark columns: values, base64, errors, URLs, strings.

Lengths are bytes; a null gives null. Letters and digits are told apart as Unicode does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwire.functions import heuristics as H
from duskwire.functions.heuristics import any_in, count_in, starts_any

# The words and marks that these heuristics look for.
COMMON_WORDS = [
    "password", "username", "function", "return", "export", "import", "require", "module", "class", "const", "default", "private", "protected", "public", "static", "application", "document", "window",
    "content", "charset", "modules",
]
TIME_ZONES = [
    "GMT", "UTC", "EST", "CST", "MST", "PST", "CET", "MSD", "Africa/", "America/", "Asia/", "Europe/", "Pacific/", "|LMT|", "|GMT|", "|BST|", "|CET|", "|CEST|",
]
TIME_ZONE_DIGITS = ["01212", "12121", "01010", "10101", "76767", "67676"]
UNICODE_PLANES = ["Basic Multilingual Plane", "BMP", "surrogate pair", "code point", "Unicode", "UTF-16", "UTF-8", "character encoding"]
OAUTH = ["oauth", "token", "access_token", "refresh_token", "bearer", "authentication", "authorization", "credentials"]
BASIC_DOCS = ["@example", "example", "caption", "sample", "usage", "<caption>", "documentation"]
MINIFIED = ["}function", "};function", ";var ", ";let ", ";const ", "return ", ".push(", ".pop(", ".shift(", ".map(", ".filter(", "function(", "=>", "&&", "||"]
CAMEL_WORDS = [
    "transition", "verify", "enable", "disable", "display", "update", "create", "delete", "remove", "get", "set", "handle", "process", "parse", "format", "convert", "validate", "check", "is", "has",
    "can", "should", "will", "did", "fetch", "load", "save", "store", "cache", "transform", "toggle", "show", "hide", "open", "close", "start", "stop", "begin", "end", "init", "setup", "register",
    "subscribe", "unsubscribe", "connect", "disconnect", "mount", "unmount", "render", "component", "element", "handler", "listener", "callback", "effect", "reducer", "action", "selector", "container",
    "provider", "consumer", "context", "fragment", "memo", "ref", "state", "props", "hook", "custom", "use", "bind", "apply", "call", "memoize", "debounce", "throttle", "MFA", "2FA", "TwoFactor", "Auth",
    "Factor", "Token", "Credential", "Password", "Login", "Logout", "Session", "Remember", "Forgot", "Reset", "Change", "Update",
]
ORIGIN_TRIAL = ["origin-trial", "originTrial", "content=", "meta http-equiv", "feature", "expiry", "isThirdParty", "recaptcha", "gstatic", "google"]
VARIABLES = [".accessToken", "=access_token", ":access_token", "oauth_token=", "accessToken:", "token:", "credential:", '"accessToken"', "'accessToken'"]
UI_LABELS = [
    "Change password", "Reset password", "Forgot password", "Change Password", "Reset Password", "Forgot Password", "changingPassword", "resetPassword", "forgotPassword",
]
UI_CONTEXTS = ["createElement", "component", "render", "label", "button", "form", "input", "<label", "<input", 'type="password"', 'type="text"', "placeholder"]
UNICODE_TERMS = ["Unicode", "UTF", "UTF-8", "UTF-16", "BMP", "Basic Multilingual", "Surrogate", "Code Point", "Encoding", "Character Set", "Charset", "fromCharCode", "charCodeAt"]
GOOGLE_FONTS = ["googleapis.com/webfonts", "fonts.googleapis.com", "google.fonts", "webfonts", "fonts?key="]
PSEUDO_CLASSES = [
    ":hover", ":active", ":focus", ":checked", ":disabled", ":enabled", ":first-child", ":last-child", ":nth-child", ":radio", ":checkbox", ":file", ":password", ":image",
]
SELECTORS = ["querySelector", "querySelectorAll", "getElementById", "getElementsBy", "$('", '$("', "jQuery", "selector", "pseudos", "Expr.pseudos", "input[type="]
UI_HEADERS = [
    "authorization", "authentication", "configuration", "settings", "credentials", "login", "register", "profile", "account", "security", "management", "overview", "details", "information",
]
HEADER_MARKS = ["<h1", "<h2", "<h3", "<h4", "<h5", "<h6", 'createElement("h', "createElement('h", ".createElement(h", "title>", "<title", "header>", "<header"]
FRAGMENT_MARKS = ["'", '"', "+", "=", ":", "{", "}", "[", "]", "var ", "let ", "const "]
FRAGMENT_CONTEXTS = ["content=", "origin", "feature", "recaptcha"]
FRAGMENT_AUTH = ["token", "jwt", "auth", "login", "user", "session", "claim", "authorization", "authenticate", "identity", "credential", "bearer"]
JS_MARKS = [
    "function", "return", "var ", "let ", "const ", "=>", "true", "false", "null", "undefined", "+", "=", ";", "{", "}", "[", "]", "base64", "encode", "decode", "JSON", "data:", "toString", "btoa",
    "atob", "charAt", ".min.js", "bundle", "webpack", "rollup", "terser",
]
DATA_URIS = ["data:image/", "data:application/", "data:text/", "data:font/", "data:audio/", "data:video/"]
BINARY_FIRST = ["00", "FF", "D8", "89", "50", "4D", "42", "4C"]
FRAGMENT_HEADS = ["AAA", "eJy", "base64", "iVBOR", "PHN2", "PD94", "PCFET", "ZXlK", "77u/", "QUJD", "Qk1X", "QkdH", "AoAEA", "d2lkdGg", "aGVpZ2h0"]
FRAGMENT_RUNS = ["AAAA", "////", "----", "abcd", "0000", "1111", "2222", "eeee", "ffff", "9999"]
SECRET_WORDS = ["key", "secret", "token", "password", "apikey", "api_key", "auth", "credential", "private", "access"]
NETWORK = ["connection refused", "connection reset", "timeout", "no such host", "network is unreachable"]
RATE_LIMIT = ["rate limit", "too many requests", "throttle", "429"]
FIREWALL = ["waf", "firewall", "blocked", "security", "403 forbidden"]
TEMPORARY = ["temporary", "retriable", "connection reset", "connection refused", "network is unreachable", "server is busy", "try again", "temporary failure"]
TIMEOUT = ["timeout", "timed out", "deadline exceeded"]
CANCELED = ["context canceled", "operation was canceled"]
CERTIFICATE = ["certificate", "x509", "tls", "ssl", "verify", "validation", "hostname", "certificate is valid for", "not valid for", "self-signed", "cert"]
SCRIPT_FOLDERS = ["/js/", "/javascript/", "/scripts/", "/assets/js/", "/dist/", "/bundle/", "/vendor/", "/lib/"]
TEXT_EXTENSIONS = [
    ".txt", ".js", ".jsx", ".ts", ".tsx", ".html", ".htm", ".css", ".json", ".xml", ".yaml", ".yml", ".md", ".csv", ".ini", ".conf", ".config", ".go", ".py", ".java", ".c", ".cpp", ".h", ".hpp", ".cs",
    ".php", ".rb", ".pl", ".sql", ".sh", ".bat", ".ps1",
]
LEAST_BYTES = {"aws_key": 16, "stripe_api_key": 16, "google_api": 16, "jwt_token": 20, "bearer_token": 20}

_SPACE = r"[\t\n\f\r ]"


def _rx(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def _n(v: Column) -> Column:
    return F.octet_length(v)


def _matches(v: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)))


# ---- values and contexts


def is_common_word(v: Column) -> Column:
    return F.lower(v).isin(COMMON_WORDS)


def is_base64_shape(v: Column) -> Column:
    return (_n(v) > 0) & ((_n(v) % 4 == 0) | F.endswith(v, F.lit("="))) & _rx(v, r"\A[A-Za-z0-9+/]*={0,2}\z")


def is_secret_candidate(kind: Column, v: Column) -> Column:
    """Whether a value of a kind is long enough for it and none of the shapes that no secret has."""
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEAST_BYTES.items() for x in kv]), kind), F.lit(8))
    dashes = F.substring(F.hex(v), 17, 2) == "2D"
    for at in (13, 18, 23):
        dashes = dashes & (F.substring(F.hex(v), 2 * at + 1, 2) == "2D")
    uuid = (H.occurrences(v, "-") == 4) & _n(v).between(32, 36) & dashes
    return (_n(v) >= least) & ~H.is_translation_key(v) & ~H.has_code_pattern(v) & ~H.is_file_path(v) & ~H.is_content_type(v) & ~uuid


def is_time_zone_data(v: Column) -> Column:
    return any_in(F.lower(v), [x.lower() for x in TIME_ZONES]) | any_in(v, TIME_ZONE_DIGITS)


def split_camel_or_number(v: Column) -> Column:
    """Pieces between a lower-case letter and an upper-case one, after two upper-case ones and before a lower-case one, and where digits begin or end."""
    cut = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu}\p{Lu})(?=\p{Ll})|(?<=\p{Nd})(?=\P{Nd})|(?<=\P{Nd})(?=\p{Nd})"
    return F.filter(F.split(v, cut, -1), lambda x: x != "")


def is_minified_sequence(v: Column) -> Column:
    hits = _matches(v, "[A-Z][0-9][A-Z][0-9]") + _matches(v, "[a-z][A-Z][0-9][a-z][A-Z]") + _matches(v, "[A-Z]{1,2}[0-9]{1,2}[A-Z]{1,2}")
    pieces = split_camel_or_number(v)
    short = F.size(F.filter(pieces, lambda x: _n(x) <= 3))
    return (hits >= 3) | ((F.size(pieces) >= 5) & (short / F.size(pieces) > 0.7))


def is_unicode_plane(c: Column) -> Column:
    return any_in(F.lower(c), [x.lower() for x in UNICODE_PLANES])


def is_analytics_id(v: Column) -> Column:
    return _rx(v, r"\AG-[A-Z0-9]{10}\z") & ~_rx(v, "G-[0-9]{1,2}[A-Z]{1,2}[0-9]{1,2}[A-Z]{1,2}[0-9]{1,2}")


def is_oauth_context(c: Column) -> Column:
    return count_in(F.lower(c), OAUTH) >= 2


def is_base64_data(v: Column) -> Column:
    return any_in(v, ["data:image", "base64"]) | ((_n(v) > 40) & is_base64_shape(v))


def is_basic_auth_syntax(v: Column, c: Column) -> Column:
    """Anything but the word Basic and credentials after it, outside documentation."""
    credentials = F.substring(v, 7, 2_000_000_000)
    real = F.startswith(v, F.lit("Basic ")) & is_base64_shape(credentials) & (_n(credentials) > 10)
    return F.startswith(v, F.lit("Basic usage")) | any_in(F.lower(c), BASIC_DOCS) | ~real


def is_minified_code(c: Column) -> Column:
    lines = H.occurrences(c, "\n")
    shapes = r"[a-z]\.[a-z]\.|[a-z]\([a-z],[a-z]\)|var [a-z]=[^;]+,[a-z]=|[a-z]\+\+|[a-z]--"
    return ((_n(c) > 200) & (lines < F.floor(_n(c) / 200))) | ((lines > 0) & (H.occurrences(c, ";") > lines * 3)) | _rx(c, shapes) | (count_in(c, MINIFIED) >= 3)


def split_camel_case(v: Column) -> Column:
    """Pieces that begin at upper-case letters."""
    return F.filter(F.split(v, r"(?s)(?<=.)(?=\p{Lu})", -1), lambda x: x != "")


def has_camel_case(v: Column) -> Column:
    words = F.transform(split_camel_case(v), lambda x: F.lower(x))
    return _rx(v, H.CAMEL) & F.arrays_overlap(words, F.array(*[F.lit(x.lower()) for x in CAMEL_WORDS]))


def is_origin_trial(c: Column) -> Column:
    return count_in(F.lower(c), ORIGIN_TRIAL) >= 2


def is_variable_reference(v: Column) -> Column:
    return any_in(v, VARIABLES) | _rx(v, rf"\A{_SPACE}*[a-zA-Z0-9_]+{_SPACE}*[.:=]{_SPACE}*[a-zA-Z0-9_.]+{_SPACE}*\z")


def is_ui_text(v: Column, c: Column) -> Column:
    return v.isin(UI_LABELS) | any_in(F.lower(c), [x.lower() for x in UI_CONTEXTS])


def is_unicode_reference(v: Column, c: Column) -> Column:
    return any_in(v, UNICODE_TERMS) | any_in(c, UNICODE_TERMS)


def is_google_font_key(v: Column, c: Column) -> Column:
    return F.startswith(v, F.lit("AIza")) & any_in(c, GOOGLE_FONTS)


def is_dom_selector(v: Column, c: Column) -> Column:
    return any_in(v, PSEUDO_CLASSES) | v.isin([x[1:] for x in PSEUDO_CLASSES]) | any_in(c, SELECTORS)


def is_ui_header(v: Column, c: Column) -> Column:
    return any_in(c, HEADER_MARKS) & starts_any(F.lower(v), [f"basic {x}" for x in UI_HEADERS])


def is_jwt(v: Column) -> Column:
    """Three parts of base64 shape; each length is told by the one before."""
    p = F.split(v, r"\.", -1)
    part = lambda i: F.get(p, F.lit(i))
    shaped = (F.size(p) == 3) & is_base64_shape(part(0)) & is_base64_shape(part(1)) & is_base64_shape(part(2))
    sized = (_n(part(0)) >= 10) & (_n(part(1)) >= _n(part(0))) & (_n(part(2)) >= 16)
    return F.coalesce(shaped & sized & F.startswith(part(0), F.lit("eyJ")) & _rx(part(2), r"[A-Za-z0-9_-]+={0,2}\z"), F.lit(False)) & v.isNotNull()


def is_base64_piece_of(v: Column, c: Column) -> Column:
    """Whether a dotted value is more likely a piece of a base64 string, or of code, than a token of three parts."""
    near = H.context_window(c, v, 15)
    bare = H.is_in_minified(c) & ~any_in(F.lower(c), FRAGMENT_AUTH)
    around = F.contains(c, v) & (count_in(near, FRAGMENT_MARKS) >= 3)
    return ~F.contains(v, F.lit(".")) | (_n(v) < 30) | (H.occurrences(v, ".") != 2) | around | any_in(c, FRAGMENT_CONTEXTS) | bare


def is_long_base64_in_code(v: Column, c: Column) -> Column:
    return (_n(v) >= 40) & _rx(v, r"\A[A-Za-z0-9+/=]+\z") & (count_in(c, JS_MARKS) >= 3)


def is_random_password(v: Column) -> Column:
    return H.is_random_secret(v, F.lit(3.5), F.lit(12), H.entropy(v))


# ---- base64

_QUANTA = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def is_base64(v: Column) -> Column:
    return _rx(v, _QUANTA)


def is_data_uri(v: Column) -> Column:
    return starts_any(v, DATA_URIS) & F.contains(v, F.lit(";base64,"))


def _decoded(v: Column) -> Column:
    """What a base64 text without its line breaks holds, in hexadecimal; null if it isn't one."""
    flat = F.regexp_replace(v, "[\r\n]", "")
    return F.when(_rx(flat, _QUANTA), F.hex(F.unbase64(flat)))


def is_binary_base64(v: Column) -> Column:
    """Base64 of data that starts as binary files do, or of whose first 100 bytes over a fifth are not printable ASCII."""
    digits = _decoded(v)
    n = F.least(F.length(digits) / 2, F.lit(100)).cast("int")
    odd = F.size(F.filter(F.regexp_extract_all(F.substring(digits, 1, 200), F.lit("(..)"), F.lit(1)), lambda b: (b < "20") | (b > "7E")))
    most = F.when(F.length(digits) / 2 < 100, F.floor(n / 5)).otherwise(20)
    return F.when(v.isNotNull(), F.coalesce(F.substring(digits, 1, 2).isin(BINARY_FIRST) | (odd > most), F.lit(False)))


def is_base64_fragment(v: Column) -> Column:
    return any_in(v, FRAGMENT_HEADS) | (count_in(v, FRAGMENT_RUNS) >= 2)


def is_secret_in_base64(v: Column) -> Column:
    """Base64 of 20 to 1000 bytes whose decoded text speaks of a secret."""
    text = F.lower(F.decode(F.unhex(_decoded(v)), "ISO-8859-1"))
    return F.coalesce(~is_base64_fragment(v) & is_base64(v) & _n(v).between(20, 1000) & ~is_data_uri(v) & ~is_binary_base64(v) & any_in(text, SECRET_WORDS), v.isNull() & F.lit(None)) & v.isNotNull()


# ---- errors: a message, with the kind that the application gave it (or null) and an HTTP status (or null)


def _kind(kind: Column | None, name: str, words: Column) -> Column:
    """An application's error is of the kind that it says; another's message tells."""
    return words if kind is None else F.when(kind.isNull(), words).otherwise(kind == name)


def is_network_error(message: Column) -> Column:
    return any_in(F.lower(message), NETWORK)


def is_rate_limit_error(message: Column, kind: Column | None = None) -> Column:
    return _kind(kind, "rate_limit", any_in(F.lower(message), RATE_LIMIT))


def is_firewall_error(message: Column, kind: Column | None = None) -> Column:
    return _kind(kind, "waf", any_in(F.lower(message), FIREWALL))


def is_temporary_error(message: Column, kind: Column | None = None) -> Column:
    return _kind(kind, "temporary", any_in(F.lower(message), TEMPORARY))


def is_timeout_error(message: Column) -> Column:
    return any_in(F.lower(message), TIMEOUT)


def is_canceled_error(message: Column) -> Column:
    return any_in(F.lower(message), CANCELED)


def is_certificate_error(message: Column, kind: Column | None = None) -> Column:
    words = any_in(F.lower(message), CERTIFICATE)
    return words if kind is None else words | F.coalesce(kind == "certificate", F.lit(False))


def is_not_found_error(kind: Column, status: Column) -> Column:
    """Only an application's error carries a status."""
    return kind.isNotNull() & F.coalesce(status == 404, F.lit(False))


def wrapped_error(message: Column, around: Column) -> Column:
    """``around: message``; no error stays none."""
    return F.concat(around, F.lit(": "), message)


# ---- strings


def truncate(v: Column, most: int) -> Column:
    """``v``, or its first bytes and three dots, ``most`` bytes in all; what a cut leaves of a character is replaced."""
    raw = F.encode(v, "UTF-8")
    return F.when(_n(v) <= most, v).otherwise(F.concat(F.decode(F.substring(raw, 1, most - 3), "UTF-8"), F.lit("...")))


def split_lines(v: Column) -> Column:
    return F.filter(F.split(v, r"\r\n|\r|\n", -1), lambda x: x != "")


def hash_string(v: Column) -> Column:
    return F.sha2(v, 256)


def has_any_prefix(v: Column, terms) -> Column:
    return starts_any(v, terms)


def has_any_suffix(v: Column, terms) -> Column:
    return _rx(v, H._quoted(terms) + r"\z")


def contains_any(v: Column, terms) -> Column:
    return any_in(v, terms)


def contains_ignore_case(v: Column, term: Column) -> Column:
    return F.contains(F.lower(v), F.lower(term))


def format_bytes(n: Column) -> Column:
    """``1.5 MB``, by 1024; whole bytes below that."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTPE", 1):
        out = F.when(n < 1024**k, out).otherwise(F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}B"))) if k > 1 else F.when(n < 1024, out).otherwise(F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB")))
    return out


def format_duration(seconds: Column) -> Column:
    s = lambda x: F.format_string("%.2f seconds", x)
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} "))
    short = F.when(seconds < 60, s(seconds)).when(minutes < 60, F.concat(part(minutes, "minutes"), s(seconds - minutes * 60)))
    return short.otherwise(F.concat(part(hours, "hours"), part(minutes - hours * 60, "minutes"), s(seconds - minutes * 60)))


# ---- URLs and file names

_URL = r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)\z"


def sanitize_url(url: Column) -> Column:
    """Trimmed, with a scheme, and with a path of at least ``/``."""
    bare = F.regexp_replace(url, r"\A[\t\n\x0B\f\r \x85\xA0]+|[\t\n\x0B\f\r \x85\xA0]+\z", "")
    full = F.when(starts_any(bare, ["http://", "https://"]), bare).otherwise(F.concat(F.lit("https://"), bare))
    return F.when(_rx(full, r"\A[A-Za-z]+://[^/?#]+(?:[?#]|\z)"), F.regexp_replace(full, r"\A([A-Za-z]+://[^/?#]+)", "$1/")).otherwise(full)


def is_script_url(url: Column) -> Column:
    from duskwire.operators.domains import is_valid_url

    low = F.lower(url)
    return is_valid_url(url) & (F.endswith(low, F.lit(".js")) | any_in(low, [".js?", ".js&"]))


def is_script_file(url: Column) -> Column:
    low = F.lower(url)
    return F.endswith(low, F.lit(".js")) | any_in(url, [".js?", ".js&"]) | any_in(low, SCRIPT_FOLDERS)


def enforce_script_extension(url: Column) -> Column:
    """``.js`` put before the query, unless the URL has it."""
    query = F.regexp_extract(F.regexp_replace(url, r"#.*\z", ""), r"\?(.+)\z", 1)
    base = F.substring_index(url, "?", 1)
    added = F.when(query != "", F.concat(base, F.lit(".js?"), query)).otherwise(F.concat(url, F.lit(".js")))
    return F.when(is_script_url(url), url).otherwise(added)


def file_extension(path: Column) -> Column:
    """The last dot of the last part of a path and what follows, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def is_text_file(path: Column) -> Column:
    return file_extension(path).isin(["", *TEXT_EXTENSIONS])
