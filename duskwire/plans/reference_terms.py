"""The fixed values once more, for the SQL: a word that is wrong on one side alone makes the two differ."""

from __future__ import annotations

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
SIGNALS = ["apikey", "api_key", "token", "secret", "password", "credential", "auth", "access"]

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
