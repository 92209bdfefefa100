"""A plain model of the scanner, character by character, for tests only."""

import datetime
import re

from tallyforge.functions.scan import AMOUNT_ANCHORS, DUE_ANCHORS, ISSUED_ANCHORS, MONTHS
from tallyforge.functions.validate import ISO_4217

SPACES = "  "
UPPER = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def alnum(c):
    return c.isascii() and c.isalnum()


def size(text):
    return len(text.encode())


def value(token):
    dot, comma = token.rfind("."), token.rfind(",")
    pos = max(dot, comma) if dot >= 0 and comma >= 0 else -1
    if pos < 0:
        for sep, at in ((".", dot), (",", comma)):
            if at >= 0 and token.count(sep) == 1 and re.fullmatch("[0-9]{2}", token[at + 1 :]):
                pos = at
    whole, rest = (token[:pos], token[pos + 1 :]) if pos >= 0 else (token, "")
    cents = (rest + "00")[:2]
    if not re.fullmatch("[0-9]{2}", cents):
        return None
    n = int("".join(c for c in whole if c.isdigit()))
    total = n * 100 + int(cents)
    return total if n < 2**63 and total < 2**63 else None


def after(text, at):
    skip = 1 if at < len(text) and text[at] in SPACES else 0
    rest = text[at + skip :]
    if len(rest) >= 4 and set(rest[:3]) <= UPPER and rest[3] == "$":
        return rest[:3], at, at + skip + 4
    if rest.startswith("US$"):
        return "USD", at, at + skip + 3
    if rest[:1] in ("€", "£"):
        return {"€": "EUR", "£": "GBP"}[rest[0]], at, at + skip + 1
    if len(rest) >= 3 and set(rest[:3]) <= UPPER and not (len(rest) > 3 and alnum(rest[3])):
        return rest[:3], at, at + skip + 3
    return None


def before(text, at):
    end = at - 1 if at and text[at - 1] in SPACES else at
    head = text[:end]
    free = lambda i: i == 0 or not alnum(text[i - 1])
    if head.endswith("$"):
        d = end - 1
        if d >= 3 and set(text[d - 3 : d]) <= UPPER and free(d - 3):
            return text[d - 3 : d], d - 3, at
        if text[max(0, d - 2) : d] == "US" and free(d - 2) and (d == 2 or text[d - 3].isascii()):
            return "USD", d - 2, at
        return None
    if head[-1:] in ("€", "£"):
        return {"€": "EUR", "£": "GBP"}[head[-1]], end - 1, at
    if end >= 3 and set(text[end - 3 : end]) <= UPPER and free(end - 3):
        return text[end - 3 : end], end - 3, at
    return None


def amounts(text):
    out = []
    for m in re.finditer("[0-9]+(?:[.,  ][0-9]+)*", text):
        n, marker = value(m[0]), after(text, m.end()) or before(text, m.start())
        if n is None or marker is None or marker[0] not in ISO_4217:
            continue
        out.append((n, marker[0], size(text[: min(m.start(), marker[1])]), size(text[: max(m.end(), marker[2])])))
    return out


def date_at(text):
    month = lambda name: next((i for i, n in enumerate(MONTHS, 1) if name.lower() in (n.lower(), n[:3].lower())), 0)
    for pattern, order in ((r"([0-9]{4})-([0-9]{2})-([0-9]{2})", "ymd"), (r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})", "dmy"), (r"([0-9]{2})/([0-9]{2})/([0-9]{4})", "dmy"), (r"([0-9]{1,2}) ([A-Za-z]+) ([0-9]{4})", "dny"), (r"([A-Za-z]+) ([0-9]{1,2}), ([0-9]{4})", "ndy")):
        if m := re.match(pattern, text):
            part = dict(zip(order, m.groups(), strict=True))
            try:
                return datetime.date(int(part["y"]), month(part["n"]) if "n" in part else int(part["m"]), int(part["d"])), m.end()
            except ValueError:
                continue
    return None


def dates(text):
    out, i = [], 0
    while i < len(text):
        if found := date_at(text[i:]):
            out.append((found[0], size(text[:i]), size(text[: i + found[1]])))
            i += found[1]
        else:
            i += 1
    return out


def anchor_ends(text, anchors):
    letter = lambda c: c.isascii() and c.isalpha()
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    out = []
    for i in range(len(text)):
        if i and letter(text[i - 1]):
            continue
        for a in anchors:
            end = i + len(a)
            if fold(text[i:end]) == a and not (end < len(text) and letter(text[end])):
                out.append(size(text[:end]))
                break
    return out


def anchored(text, anchors, found):
    for end in anchor_ends(text, anchors):
        near = [m for m in found if end <= m[-2] <= end + 40]
        if near:
            return min(near, key=lambda m: m[-2])
    return None


def scan(text):
    money, days = amounts(text), dates(text)
    amount = anchored(text, AMOUNT_ANCHORS, money)
    best = (*amount, 90) if amount else None
    if not best and money:
        best = (*max(reversed(money), key=lambda m: m[0]), 40)
    due = anchored(text, DUE_ANCHORS, days)
    other = [d for d in days if due is None or d[1:] != due[1:]]
    issued = anchored(text, ISSUED_ANCHORS, other)
    return best, (*due, 90) if due else None, (*issued, 90) if issued else (*other[0], 40) if other else None


def strip_html(html, blocks, entities):
    """Tag by tag; what stands between two tags is decoded by itself, once."""
    html = re.sub(r"<[^>]*\Z", "", html)
    tags = re.compile(rf"\s*(?:/\s*(?:{'|'.join(blocks)})|br(?:[\s/].*)?)\s*", re.I | re.S | re.A)

    def entity(m):
        if m[1]:
            return entities[m[1]]
        n = int(m[2])
        return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]

    out = []
    for piece in re.split(r"(<[^>]*>)", html):
        if piece.startswith("<") and piece.endswith(">"):
            out.append(" " if tags.fullmatch(piece[1:-1]) else "")
        else:
            out.append(re.sub(rf"&({'|'.join(entities)});|&#([0-9]{{1,9}});", entity, piece))
    return "".join(out)
