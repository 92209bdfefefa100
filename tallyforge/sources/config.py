"""Settings from environment variables, read on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

Get = Callable[[str], str | None]
POLL_SECONDS = 1800


class MissingSetting(ValueError):
    """A variable that is needed is unset, or has a value that can't be."""


def _required(get: Get, name: str) -> str:
    value = get(name)
    if not value:
        raise MissingSetting(name)
    return value


@dataclass(frozen=True)
class MailSettings:
    client_id: str
    secret: str = field(repr=False)
    refresh: str = field(repr=False)
    label: str
    poll_seconds: int = POLL_SECONDS


def mail_settings(get: Get) -> MailSettings | None:
    """None unless MAIL_CLIENT_ID is set; then the others must be."""
    client = get("MAIL_CLIENT_ID")
    if not client:
        return None
    seconds = get("MAIL_POLL_SECONDS") or str(POLL_SECONDS)
    if not seconds.isdecimal() or int(seconds) < 1:
        raise MissingSetting("MAIL_POLL_SECONDS")
    return MailSettings(client, _required(get, "MAIL_CLIENT_SECRET"), _required(get, "MAIL_REFRESH_TOKEN"), _required(get, "MAIL_LABEL"), int(seconds))


@dataclass(frozen=True)
class ModelSettings:
    provider: str
    model: str
    key: str | None = field(repr=False)
    base_url: str


#: Variables of each provider: its key (None if it needs none) and its address; the address where that is unset.
PROVIDERS = {
    "ollama": (None, "OLLAMA_API_BASE_URL", "http://localhost:11434"),
    "anthropic": ("ANTHROPIC_API_KEY", "ANTHROPIC_BASE_URL", "https://api.anthropic.com"),
    "openai": ("OPENAI_API_KEY", "OPENAI_BASE_URL", "https://api.openai.com/v1"),
}


def model_settings(get: Get) -> ModelSettings | None:
    """None unless MODEL_PROVIDER is set; an unknown provider or a missing key is an error."""
    provider = get("MODEL_PROVIDER")
    if provider is None:
        return None
    model = _required(get, "MODEL_NAME")
    if provider not in PROVIDERS:
        raise MissingSetting("MODEL_PROVIDER")
    key, url, address = PROVIDERS[provider]
    return ModelSettings(provider, model, _required(get, key) if key else None, (get(url) or address).rstrip("/"))
