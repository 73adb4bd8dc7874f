"""Settings with their gates; nothing is read or checked on import."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    provider: str = "local"
    model: str = ""
    encoder: str = ""
    collection: str = "file_embeddings"
    parent_size: int = 1500
    child_size: int = 400
    chars_per_token: float = 3.5
    parent_id_factor: int = 100_000
    coerce_threshold: float = 0.80
    coerce_tie: float = 0.02
    max_repairs: int = 1
    rerank_pool: int = 50
    rerank_top_k: int = 10
    summary_budget_tokens: int = 3_000
    max_pending: int = 500
    callback_attempts: int = 3
    callback_backoff_s: float = 1.0
    preview_chars: int = 2_000
    log_level: str = "INFO"
    query_prefix: str = "zapytanie: "
    context_tokens: int = 10_000
    retry_after_s: int = 10
    debug: bool = False

    def validate(self) -> Settings:
        if self.provider not in ("local", "hosted"):
            raise ConfigError(f"unknown provider {self.provider!r}")
        for name in ("parent_size", "child_size", "parent_id_factor", "rerank_pool", "rerank_top_k", "summary_budget_tokens", "max_pending", "callback_attempts"):
            if getattr(self, name) < 1:
                raise ConfigError(f"{name} must be positive")
        if not 0 <= self.coerce_threshold <= 1 or not 0 <= self.coerce_tie <= 1:
            raise ConfigError("coercion limits must lie between 0 and 1")
        if self.chars_per_token <= 0:
            raise ConfigError("chars_per_token must be positive")
        return self


def gated(values: Mapping[str, str], name: str, default: str) -> str:
    """An override counts only with its gate, and neither is allowed without the other."""
    override, allowed = values.get(f"{name}_OVERRIDE", "").strip(), _flag(values.get(f"ALLOW_{name}_OVERRIDE", ""))
    if bool(override) != allowed:
        raise ConfigError(f"{name}_OVERRIDE and ALLOW_{name}_OVERRIDE=true must be given together")
    return override or default


def _flag(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


def load(values: Mapping[str, str] | None = None) -> Settings:
    """Settings from a mapping (the environment by default), typed by their defaults."""
    values = os.environ if values is None else values
    given: dict[str, object] = {}
    for f in fields(Settings):
        raw = values.get(f.name.upper(), "").strip()
        if f.name in ("model", "encoder", "provider", "debug") or not raw:  # gates below
            continue
        try:
            given[f.name] = type(f.default)(raw)
        except ValueError as e:
            raise ConfigError(f"{f.name.upper()}={raw!r} is not a {type(f.default).__name__}") from e
    # an explicit provider wins over one told by its key
    given["provider"] = values.get("LLM_PROVIDER", "").strip().lower() or ("hosted" if values.get("LLM_API_KEY") else "local")
    given["model"] = gated(values, "MODEL", "")
    given["encoder"] = gated(values, "ENCODER", "")
    debug = _flag(values.get("DEBUG", ""))
    if debug and not _flag(values.get("DEBUG_ACKNOWLEDGED", "")):
        raise ConfigError("DEBUG shows document contents in logs; DEBUG_ACKNOWLEDGED=true must confirm it")
    return Settings(**given, debug=debug).validate()  # type: ignore[arg-type]


def context_budget(model: str, windows: Mapping[str, int] | None = None, share: float = 0.8, unknown: int = 10_000) -> int:
    """Tokens of context a model's prompt may take, by a part of the model's name."""
    for part, window in (windows or {"qwen": 30_000, "llama": 131_000}).items():
        if part in model.lower():
            return int(share * window)
    return unknown


def encoder_fits(settings: Settings, max_tokens: int) -> bool:
    """Whether children of the set size fit the encoder, so that none is cut off when it is embedded."""
    return settings.child_size <= int(max_tokens * settings.chars_per_token)
