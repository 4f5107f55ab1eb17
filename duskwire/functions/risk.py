"""Risk levels of finding types, by name, then category, then words in the name."""

from __future__ import annotations

# Types of a level by name, and the levels of categories.
HIGH = [
    "private_key_content", "private_key_var", "web3_private_key", "aws_secret_key", "github_personal_token", "github_token", "github_fine_grained_token", "gitlab_personal_token", "gitlab_runner_token",
    "docker_hub_token", "npm_access_token", "slack_token", "sentry_auth_token", "shopify_private_app_token", "shopify_custom_app_token", "stripe_secret_key", "supabase_service_role_key",
]
INFORMATIVE = ["google_recaptcha_key", "ethereum_address", "public_key", "public_key_content", "stripe_test_publishable_key", "stripe_test_secret_key"]
LOW = ["google_api_key", "google_cloud_platform", "stripe_publishable_key", "supabase_anon_key", "supabase_publishable_key", "session_token"]
CATEGORY = (
    dict.fromkeys(["pii", "web3"], "informative")
    | dict.fromkeys(["gcp", "generic"], "low")
    | dict.fromkeys(["auth", "aws", "azure", "code", "config", "crypto", "db", "llm", "payment", "ci", "bash"], "high")
    | {"cloud": "medium"}
)
NAMED = dict.fromkeys(HIGH, "high") | dict.fromkeys(INFORMATIVE, "informative") | dict.fromkeys(LOW, "low")


def risk_of(name: str, category: str = "") -> str:
    key = name.strip().lower()
    if not key:
        return "medium"
    if level := NAMED.get(key) or CATEGORY.get(category.strip().lower()):
        return level
    has = lambda *words: any(w in key for w in words)
    if has("private", "secret", "token"):
        return "low" if has("publishable", "public") else "high"
    if has("publishable"):
        return "low"
    return "informative" if has("public", "email", "phone") else "medium"
