"""Encoding of whole texts, pre-token by pre-token, with worker-wide caches.

A byte-level BPE tokenizer encodes each pre-token on its own, so a text's ids are those of its pre-tokens one
after another. Texts of Latin-1 characters are split here by the same pattern with its classes written out;
other texts are split by the library. A pre-token encodes alone as it does inside a text. Special strings end a piece and are ids of their own, as the
library has it.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Callable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN1 = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: The character that stands for each byte in a byte-level vocabulary: itself where it can be printed, else the next one from 256 on.
_printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b for b in _printed} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_printed}))}
#: Entries of a worker's cache, in two halves: when the younger is full it becomes the older, and what is asked for again moves to the younger. Longer pre-tokens
#: are encoded anew each time.
CACHE = 600_000
CACHED_LENGTH = 64


class PreTokenEncoder:
    """Values of whole texts as sequences of values of pre-tokens; of: ids -> the value of a pre-token."""

    def __init__(self, path: str, of: Callable[[list[int]], object], known: dict[str, object] | None = None) -> None:
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.of = of
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pre = spec.get("pre_tokenizer") or {}
        #: whether pre-tokens are independent; else whole texts go to the library
        self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.piece = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = known or {}
        self.cache: dict[str, object] = dict(self.known)
        self.older: dict[str, object] = {}

    def pre_tokens(self, piece: str) -> list[str]:
        try:
            piece.encode("latin-1")
        except UnicodeEncodeError:
            return [piece[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        return LATIN1.findall(piece)

    def value(self, token: str) -> object:
        """The value of one pre-token, by the library's model, which takes its bytes as characters."""
        return self.of([t.id for t in self.model.tokenize(token.encode().decode("latin-1").translate(BYTES))])

    def _missed(self, token: str) -> object:
        """What isn't in the younger half of the cache: from the older half, or made."""
        found = self.cache.get(token)
        if found is None:
            found = self.older.get(token)
            if found is None:
                found = self.value(token)
            if len(token) <= CACHED_LENGTH:
                if len(self.cache) >= CACHE // 2 + len(self.known):
                    self.older, self.cache = self.cache, dict(self.known)
                self.cache[token] = found
        return found

    def values(self, text: str) -> list[object]:
        """The values of the text's pre-tokens, in order."""
        if not self.splits:
            return [self.of(self.library.encode(text, add_special_tokens=False).ids)] if text else []
        if self.special and any(s in text for s in self.special):
            out: list[object] = []
            for i, piece in enumerate(self.piece.split(text)):
                out += [self.of([self.special[piece]])] if i % 2 else self._of_piece(piece)
            return out
        return self._of_piece(text)

    def _of_piece(self, piece: str) -> list[object]:
        tokens = self.pre_tokens(piece)
        got = [*map(self.cache.get, tokens)]
        for at in [i for i, v in enumerate(got) if v is None] if None in got else ():
            got[at] = self._missed(tokens[at])
        return got


@functools.cache
def encoder(path: str, kind: str) -> PreTokenEncoder:
    """One for each worker process, kept between its tasks. kind: "ids" (4 bytes each, little-endian) or "length"."""
    return PreTokenEncoder(path, (lambda ids: struct.pack(f"<{len(ids)}I", *ids)) if kind == "ids" else len)
