"""The text layer of PDF files: content streams, plain or deflated, and the strings they show, by the fonts' own tables where these have one.

Strings of fonts without a table are taken as Windows-1252. Pages come in the order of the file, each moved or new line as a line of its own. A page image without text has
no layer. Encrypted files, other filters than deflate and streams above MOST bytes are an error where text is shown by them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

PDF_TYPE = "application/pdf"
MOST = 64 << 20
#: A gap between the strings of an array, in thousandths of the font's size, that is read as a blank.
GAP = -200
_header = re.compile(rb"(\d{1,10})\s{1,9}\d{1,5}\s{1,9}obj\b")
_reference = re.compile(rb"(\d{1,10})\s{1,9}\d{1,5}\s{1,9}R\b")
_font = re.compile(rb"/([^\s/<>\[\]()]+)\s{1,9}(\d{1,10})\s{1,9}\d{1,5}\s{1,9}R\b")
_token = re.compile(rb"(?P<open>\()|<(?P<hex>[0-9A-Fa-f\s]*)>|/(?P<name>[^\s/<>\[\]()]+)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<operator>[A-Za-z][A-Za-z0-9]*\*?|['\"])")
_inline_end = re.compile(rb"\sEI\b")
_bracket = re.compile(rb"\\.|[()]", re.S)
_escape = re.compile(rb"\\(\r\n|[\r\n]|[nrtbf()\\]|[0-7]{1,3})")
_plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_chars = re.compile(rb"beginbfchar(.*?)endbfchar", re.S)
_ranges = re.compile(rb"beginbfrange(.*?)endbfrange", re.S)
_range = re.compile(rb"<([^<>]*)>\s*<([^<>]*)>\s*(?:<([^<>]*)>|\[([^\]]*)\])")
_hex = re.compile(rb"<([^<>]*)>")

Table = dict[bytes, str]


class Broken(Exception):
    """Not a PDF, or one that ends early."""


def _unhex(digits: bytes) -> bytes:
    digits = b"".join(digits.split())
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    except ValueError as e:
        raise Broken(f"hexadecimal: {e}") from e


def _inflated(head: bytes, data: bytes) -> bytes:
    if b"FlateDecode" not in head:
        return data
    inflate = zlib.decompressobj()
    try:
        out = inflate.decompress(data, MOST)
    except zlib.error as e:
        raise Broken(f"stream: {e}") from e
    if inflate.unconsumed_tail:
        raise Broken(f"stream: above {MOST} bytes")
    return out


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Each object's dictionary and its stream as stored, in the order of the file."""
    found: dict[int, tuple[bytes, bytes | None]] = {}
    for piece in data.split(b"endobj"):
        if not (start := _header.search(piece)):
            continue
        head, streamed, rest = piece[start.end() :].partition(b"stream")
        rest = rest.removeprefix(b"\r").removeprefix(b"\n")
        end = rest.rfind(b"endstream")
        found[int(start[1])] = head, rest[: end if end >= 0 else None] if streamed else None
    for head, stored in list(found.values()):
        if b"/ObjStm" in head and stored is not None and (first := re.search(rb"/First\s+(\d+)", head)):
            packed, at = _inflated(head, stored), int(first[1])
            numbers = [int(n) for n in packed[:at].split() if n.isdigit()]
            places = [*numbers[1::2], len(packed) - at]
            for n, number in enumerate(numbers[: len(places) * 2 - 2 : 2]):
                found.setdefault(number, (packed[at + places[n] : at + places[n + 1]], None))
    return found


def _table(cmap: bytes) -> Table:
    """What a font's codes stand for."""
    table: Table = {}
    text = lambda digits: _unhex(digits).decode("utf-16-be", "replace")
    for part in _chars.findall(cmap):
        codes = _hex.findall(part)
        table |= {_unhex(a): text(b) for a, b in zip(codes[::2], codes[1::2], strict=False)}
    for part in _ranges.findall(cmap):
        for low, high, first, each in _range.findall(part):
            start, width = _unhex(low), len(_unhex(low))
            low_, high_ = int.from_bytes(start), int.from_bytes(_unhex(high))
            if high_ - low_ > 0xFFFF:
                raise Broken("range of codes")
            if each:
                shown = [text(x) for x in _hex.findall(each)]
            else:
                base = text(first)
                shown = [base[:-1] + chr(min(ord(base[-1]) + i, 0x10FFFF)) for i in range(high_ - low_ + 1)] if base else []
            table |= {(low_ + i).to_bytes(width): s for i, s in enumerate(shown[: high_ - low_ + 1])}
    return table


def _fonts(objects: dict[int, tuple[bytes, bytes | None]]) -> tuple[dict[int, dict[bytes, Table]], dict[bytes, Table]]:
    """For each content stream of a page the tables of its fonts by name, of all fonts where the page names none that has one; and those of all fonts."""
    tables: dict[int, Table] = {}
    for number, (head, _) in objects.items():
        if (to := re.search(rb"/ToUnicode\s+(\d+)", head)) and (cmap := objects.get(int(to[1]))) and cmap[1] is not None:
            tables[number] = _table(_inflated(*cmap))
    named = lambda head: {name: tables[int(n)] for name, n in _font.findall(head) if int(n) in tables}
    every: dict[bytes, Table] = {}
    own: dict[int, dict[bytes, Table]] = {}
    for head, _ in objects.values():
        every |= named(head)
        if contents := re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head):
            # the resources and the font dictionary stand in the page or are objects of their own, an array of streams likewise
            near = [head] + [objects[int(n)][0] for n in re.findall(rb"/(?:Resources|Font)\s+(\d+)", head) if int(n) in objects]
            near += [objects[int(n)][0] for h in near[1:] for n in re.findall(rb"/Font\s+(\d+)", h) if int(n) in objects]
            for n in map(int, _reference.findall(contents[1])):
                streams = [n] if n not in objects or objects[n][1] is not None else map(int, _reference.findall(objects[n][0]))
                own |= {x: {k: t for h in near for k, t in named(h).items()} or every for x in streams}
    return own, every


def _decoded(raw: bytes, table: Table | None) -> str:
    if table:
        width = len(next(iter(table)))
        return "".join(table.get(raw[i : i + width], "") for i in range(0, len(raw), width))
    return raw.decode("utf-16", "replace") if raw.startswith((b"\xfe\xff", b"\xff\xfe")) else raw.decode("cp1252", "replace")


def _literal(content: bytes, at: int) -> tuple[bytes, int]:
    """The string whose bracket opens before `at`, and where it ends; brackets inside are in pairs."""
    depth = 1
    for mark in _bracket.finditer(content, at):
        depth += {b"(": 1, b")": -1}.get(mark[0], 0)
        if not depth:
            raw = _escape.sub(lambda m: _plain.get(m[1], m[1]) if not m[1].isdigit() else bytes([int(m[1], 8) & 255]), content[at : mark.start()])
            return raw, mark.end()
    raise Broken("string without an end")


def _shown(content: bytes, fonts: dict[bytes, Table]) -> Iterator[str]:
    at, given, name, font, gap = 0, [], b"", None, False
    while token := _token.search(content, at):
        at, kind = token.end(), token.lastgroup
        if kind == "open":
            raw, at = _literal(content, at)
            given.append(raw)
        elif kind == "hex":
            given.append(_unhex(token["hex"]))
        elif kind == "name":
            name = token["name"]
        elif kind == "number":
            given.append(float(token["number"]))
        else:
            operator = token["operator"]
            if operator == b"Tf":
                font = fonts.get(name)
            elif operator in (b"T*", b"Td", b"TD", b"Tm", b"ET", b"'", b'"'):
                yield "\n"
            if operator in (b"Tj", b"TJ", b"'", b'"'):
                line = ""
                for x in given:
                    if isinstance(x, bytes):
                        shown = _decoded(x, font)
                        line += " " + shown if gap and line and not line[-1].isspace() and not shown[:1].isspace() else shown
                    gap = operator == b"TJ" and not isinstance(x, bytes) and x < GAP
                yield line
            elif operator == b"ID":
                end = _inline_end.search(content, at)
                at = end.end() if end else len(content)
            given = []


def text_layer(data: bytes) -> str | None:
    """The text, or None if nothing is shown."""
    if not data.startswith(b"%PDF-") or b"%%EOF" not in data[-1024:]:
        raise Broken("no PDF header or end")
    if re.search(rb"/Encrypt\s+\d", data):
        raise Broken("encrypted")
    objects = _objects(data)
    own, every = _fonts(objects)
    out: list[str] = []
    for number, (head, stored) in objects.items():
        # what pages and forms show; any stream where no page is found
        if stored is None or own and number not in own and not re.search(rb"/Subtype\s*/Form\b", head):
            continue
        if re.search(rb"/Subtype\s*/Image\b|/ObjStm\b|/XRef\b", head):
            continue
        content = _inflated(head, stored)
        if b"BT" in content:
            out += _shown(content, own.get(number, every))
    text = "".join(out)
    return text if text.strip() else None
