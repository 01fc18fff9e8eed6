"""Settings from the environment, checked when they are read."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from quillgraph.errors import ConfigurationError

_TRUE, _FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass(frozen=True)
class Config:
    texts: str = "data/texts"
    pattern: str = "*.txt"
    lexicon: str = "data/lexicon.json"
    manifest: str = ""
    artifacts: str = "artifacts"
    max_path_length: int = 3
    optional_rules: bool = True
    log_level: str = "WARN"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """QUILL_<FIELD> for each field; what is unset keeps its default."""
        env = os.environ if env is None else env
        values = {}
        for name, default in cls().__dict__.items():
            raw = env.get(f"QUILL_{name.upper()}")
            if raw is not None:
                values[name] = _typed(f"QUILL_{name.upper()}", raw.strip(), type(default))
        return cls(**values)


def _typed(name: str, raw: str, kind: type):
    if kind is bool:
        if raw.lower() not in _TRUE + _FALSE:
            raise ConfigurationError(f"{name} must be true or false, not {raw!r}")
        return raw.lower() in _TRUE
    if kind is int:
        if not raw.isdigit() or int(raw) < 1:
            raise ConfigurationError(f"{name} must be a whole number of at least 1, not {raw!r}")
        return int(raw)
    return raw
