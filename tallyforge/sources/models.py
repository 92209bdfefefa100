"""Clients of language models: one request a bill, over an injected transport."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from tallyforge.operators.model_pass import Image, Part, Pdf, Unreachable
from tallyforge.sources.config import ModelSettings
from tallyforge.sources.mail import TransportError, _send

Send = Callable[[str, str, dict, bytes | None], tuple[int, bytes]]
#: Tokens of an answer, at most.
ANSWER = 1024


class Unsupported(Exception):
    """The provider doesn't take a part of this kind."""


def _coded(data: bytes) -> str:
    return base64.b64encode(data).decode()


def _ollama(s: ModelSettings, text: str, parts: list[Part]) -> tuple[str, dict, dict]:
    if any(isinstance(p, Pdf) for p in parts):
        raise Unsupported("ollama takes no whole PDF")
    message = {"role": "user", "content": "\n\n".join([text, *(p for p in parts if isinstance(p, str))]), "images": [_coded(p.data) for p in parts if isinstance(p, Image)]}
    return f"{s.base_url}/api/chat", {}, {"model": s.model, "stream": False, "format": "json", "messages": [message]}


def _openai(s: ModelSettings, text: str, parts: list[Part]) -> tuple[str, dict, dict]:
    def one(p: Part) -> dict:
        if isinstance(p, str):
            return {"type": "text", "text": p}
        if isinstance(p, Image):
            return {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{_coded(p.data)}"}}
        return {"type": "file", "file": {"filename": "bill.pdf", "file_data": f"data:application/pdf;base64,{_coded(p.data)}"}}

    content = [one(p) for p in [text, *parts]]
    return f"{s.base_url}/chat/completions", {"Authorization": f"Bearer {s.key}"}, {"model": s.model, "response_format": {"type": "json_object"}, "messages": [{"role": "user", "content": content}]}


def _anthropic(s: ModelSettings, text: str, parts: list[Part]) -> tuple[str, dict, dict]:
    def one(p: Part) -> dict:
        if isinstance(p, str):
            return {"type": "text", "text": p}
        kind, media = ("image", "image/png") if isinstance(p, Image) else ("document", "application/pdf")
        return {"type": kind, "source": {"type": "base64", "media_type": media, "data": _coded(p.data)}}

    content = [one(p) for p in [text, *parts]]
    return f"{s.base_url}/v1/messages", {"x-api-key": s.key or "", "anthropic-version": "2023-06-01"}, {"model": s.model, "max_tokens": ANSWER, "messages": [{"role": "user", "content": content}]}


_requests = {"ollama": _ollama, "openai": _openai, "anthropic": _anthropic}
_answers = {"ollama": lambda r: r["message"]["content"], "openai": lambda r: r["choices"][0]["message"]["content"], "anthropic": lambda r: "".join(c["text"] for c in r["content"] if c.get("type") == "text")}


@dataclass(frozen=True)
class ModelClient:
    """Sent to the workers whole; it shows neither its key nor its transport."""

    settings: ModelSettings
    send: Send = field(default=_send, repr=False)

    def complete(self, instructions: str, parts: list[Part], keys: list[str]) -> str:
        """The answer's text. What can't be reached, or answers with an error or nothing, is Unreachable; a part that isn't taken, Unsupported."""
        s = self.settings
        url, headers, body = _requests[s.provider](s, f"{instructions}\nKeys: {', '.join(keys)}", parts)
        try:
            status, reply = self.send("POST", url, {"Content-Type": "application/json"} | headers, json.dumps(body).encode())
        except TransportError as e:
            raise Unreachable(str(e)) from e
        if not 200 <= status < 300:
            raise Unreachable(f"status {status}")
        try:
            return _answers[s.provider](json.loads(reply))
        except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
            raise Unreachable("an answer without text") from e
