"""A tolerant look-up of elements by local names in XML that need not be well-formed."""

from __future__ import annotations

import bisect
import functools
import re
from typing import NamedTuple

_tag = re.compile(r"<(?![?!])([^>]*)>")
_entity = re.compile(r"&(amp|lt|gt|apos|quot);")
# The entities of XML.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "apos": "'", "quot": '"'}


class Element(NamedTuple):
    text: str
    start: int  # of the body, in bytes of UTF-8
    end: int
    attributes: str


def local(name: str) -> str:
    return name.rpartition(":")[2]


def _name(inner: str) -> tuple[str, str, bool]:
    """Local name, attributes, and whether the tag closes itself."""
    stripped = inner.rstrip()
    core = stripped[:-1].rstrip() if stripped.endswith("/") else inner
    parts = core.split(None, 1) if core[:1].strip() else ["", core]
    return local(parts[0] if parts else ""), parts[1].strip() if len(parts) > 1 else "", stripped.endswith("/")


def _read(inner: str) -> tuple[str, int, str]:
    """Local name, kind (1 opens an element, 0 is a whole one, -1 closes one) and attributes of what stands in a tag."""
    if inner.startswith("/"):
        return local(inner[1:].strip()), -1, ""
    name, attributes, empty = _name(inner)
    return name, 0 if empty else 1, attributes


#: Tags that are alike are read once; long ones aren't kept.
_known, _LONG = functools.lru_cache(4096)(_read), 200


class Document:
    """The tags of some local names, found in one pass; every look-up is in these lists."""

    def __init__(self, xml: str, names: frozenset[str]) -> None:
        self.xml, self.ascii = xml, xml.isascii()
        #: Start, end, kind and attributes of each tag.
        self.tags: dict[str, list[tuple[int, int, int, str]]] = {n: [] for n in names}
        for tag in _tag.finditer(xml):
            inner = tag[1]
            name, kind, attributes = _known(inner) if len(inner) <= _LONG else _read(inner)
            if name in self.tags:
                self.tags[name].append((*tag.span(), kind, attributes))
        self.found: dict[tuple[int, int, str], tuple[int, int, str] | None] = {}

    def _locate(self, start: int, end: int, name: str) -> tuple[int, int, str] | None:
        """Body start, body end and attributes of the first such element; same-named elements inside are balanced."""
        tags, depth, first = self.tags[name], 0, None
        for at in range(bisect.bisect_left(tags, (start,)), len(tags)):
            begins, ends, kind, attributes = tags[at]
            if ends > end:
                return None
            if first is None:
                if kind == 0:
                    return ends, ends, attributes
                first = (ends, attributes) if kind == 1 else None
            elif kind == -1 and not depth:
                return first[0], begins, first[1]
            else:
                depth += kind
        return None

    def find(self, parents: list[str], name: str) -> Element | None:
        """The first `name` inside the first of each parent in turn. Sections of character data are looked into."""
        start, end, attributes = 0, len(self.xml), ""
        for step in [*parents, name]:
            at = (start, end, step)
            if at not in self.found:
                self.found[at] = self._locate(*at)
            found = self.found[at]
            if found is None:
                return None
            start, end, attributes = found
        body = self.xml[start:end]
        before = start if self.ascii else len(self.xml[:start].encode("utf-8", "replace"))
        return Element(text_of(body), before, before + (len(body) if self.ascii else len(body.encode("utf-8", "replace"))), attributes)


def find(xml: str, parents: list[str], name: str) -> Element | None:
    return Document(xml, frozenset([*parents, name])).find(parents, name)


def attribute(element: Element, name: str) -> str | None:
    found = re.search(re.escape(name) + '="([^"]*)"', element.attributes)
    return found[1] if found else None


def text_of(raw: str) -> str:
    body = raw.strip()
    if body.startswith("<![CDATA["):
        body = body.removeprefix("<![CDATA[").removesuffix("]]>")
    return _entity.sub(lambda m: ENTITIES[m[1]], body) if "&" in body else body
