"""Settings of a run, read from and written to a YAML file."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields


@dataclass
class Settings:
    timeout: int = 30
    max_retries: int = 3
    concurrency: int = 10
    rate_limit: int = 0  # requests a second for each host; 0 adapts
    input_file: str = ""
    output_file: str = ""
    verbose: bool = False
    regex_file: str = ""


def load(path: str) -> Settings:
    """The defaults, with what the file names in their place; a missing file changes nothing, unknown keys are passed over."""
    import yaml

    if not os.path.exists(path):
        return Settings()
    with open(path, encoding="utf-8") as f:
        named = yaml.safe_load(f.read()) or {}
    known = {x.name for x in fields(Settings)}
    return Settings(**{k: v for k, v in named.items() if k in known and v is not None})


def save(settings: Settings, path: str) -> None:
    import yaml

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(yaml.safe_dump(asdict(settings), sort_keys=False))
