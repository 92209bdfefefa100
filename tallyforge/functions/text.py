"""Encodings, formats and HTML as columns."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import validate


def raw_hash(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def hex_id(content: Column) -> Column:
    return F.sha2(content, 256)


def base64url(content: Column, padded: bool = True) -> Column:
    """RFC 4648, section 5, in one line."""
    text = F.translate(F.regexp_replace(F.base64(content), "[\r\n]", ""), "+/", "-_")
    return text if padded else F.rtrim(F.translate(text, "=", " "))


def unbase64url(text: Column) -> Column:
    """Padded or not; null for other characters or a length that can't be."""
    bare = F.regexp_replace(text, "=+$", "")
    whole = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    good = text.rlike("^[A-Za-z0-9_-]*={0,2}$") & (F.length(bare) % 4 != 1) & ((F.length(text) == F.length(bare)) | (F.length(text) % 4 == 0))
    return F.when(good, F.try_to_binary(F.translate(whole, "-_", "+/"), F.lit("base64")))


def pkce_challenge(verifier: Column) -> Column:
    return base64url(F.unhex(F.sha2(verifier, 256)), padded=False)


def percent_encode(text: Column) -> Column:
    """RFC 3986: all but unreserved characters, by byte. Form encoding differs in the blank, the tilde and the asterisk."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def id_prefix(bill_id: Column) -> Column:
    return F.substring(bill_id, 1, 8)


def or_dash(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("-"))


def money_format(minor: Column, code: Column) -> Column:
    """-12.34 EUR; two decimals whatever the currency; a dash for none."""
    digits = F.regexp_replace(minor.cast("string"), "^-", "")
    whole = F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), "0")
    sign = F.when(minor < 0, "-").otherwise("")
    shown = F.concat(sign, F.substring(whole, F.lit(1), F.length(whole) - 2), F.lit("."), F.right(whole, F.lit(2)), F.lit(" "), code)
    return F.coalesce(shown, F.lit("-"))


def period_format(start: Column, end: Column) -> Column:
    return F.coalesce(F.concat(start.cast("string"), F.lit(".."), end.cast("string")), F.lit("-"))


def json_date(day: Column) -> Column:
    """[year, day of the year]."""
    return F.when(day.isNotNull(), F.array(F.year(day), F.dayofyear(day)))


def unjson_date(pair: Column) -> Column:
    first = F.try_to_date(F.concat(F.lpad(F.get(pair, F.lit(0)).cast("string"), 4, "0"), F.lit("-01-01")), "yyyy-MM-dd")
    day = F.date_add(first, (F.get(pair, F.lit(1)) - 1).cast("int"))
    return F.when((F.get(pair, F.lit(1)) >= 1) & (F.year(day) == F.year(first)), day)


def bill_json(id: Column, vendor: Column, minor: Column, code: Column, start: Column, end: Column, issued: Column, due: Column, status: Column) -> Column:
    amount = F.when(minor.isNotNull() & code.isNotNull(), F.struct(minor.alias("minor_units"), code.alias("currency")))
    period = F.when(start.isNotNull() & end.isNotNull(), F.struct(json_date(start).alias("start"), json_date(end).alias("end")))
    return F.to_json(F.struct(id.alias("id"), vendor.alias("vendor"), amount.alias("amount"), period.alias("period"), json_date(issued).alias("issued"), json_date(due).alias("due"), status.alias("status")), {"ignoreNullFields": "false"})


#: A bill as JSON has it.
BILL_JSON = "id string, vendor string, amount struct<minor_units:bigint,currency:string>, period struct<start:array<int>,end:array<int>>, issued array<int>, due array<int>, status string"


def unbill_json(json: Column) -> Column:
    """A bill out of JSON as its flat columns, checked as any other: null for what isn't one of these, or couldn't be a bill."""
    j = F.from_json(json, BILL_JSON)
    days = {"period_start": unjson_date(j["period"]["start"]), "period_end": unjson_date(j["period"]["end"]), "issued": unjson_date(j["issued"]), "due": unjson_date(j["due"])}
    given = {"period_start": j["period"]["start"], "period_end": j["period"]["end"], "issued": j["issued"], "due": j["due"]}
    flat = {"id": j["id"], "vendor": j["vendor"], "amount_minor": j["amount"]["minor_units"], "currency": j["amount"]["currency"], **days, "status": j["status"]}
    whole_amount = j["amount"].isNull() | (flat["amount_minor"].isNotNull() & flat["currency"].isNotNull())
    whole_period = j["period"].isNull() | (days["period_start"].isNotNull() & days["period_end"].isNotNull())
    sound = validate.is_bill_id(flat["id"]) & whole_amount & whole_period & validate.broken_invariant(flat["status"], flat["vendor"], flat["amount_minor"], flat["currency"], days["period_start"], days["period_end"], days["issued"]).isNull()
    for name, day in days.items():
        sound &= day.isNotNull() | given[name].isNull()
    return F.when(F.coalesce(sound, F.lit(False)), F.struct(*[c.alias(n) for n, c in flat.items()]))


def strip_fence(reply: Column) -> Column:
    """A reply without the code fence around it, if there is one."""
    bare = F.regexp_replace(reply, r"^\s+|\s+\z", "")
    inner = F.regexp_replace(bare, r"^```(?:json)?[\r\n]*", "")
    closed = F.when(inner.endswith("```"), F.regexp_replace(inner, r"\s*```\z", "")).otherwise(inner)
    return F.when(bare.startswith("```"), closed).otherwise(bare)


# Tags whose end becomes a blank, and the entities that are decoded.
BLOCK_TAGS = ["td", "tr", "th", "p", "div", "table", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tbody", "thead", "tfoot", "section", "blockquote"]
ENTITIES = {"nbsp": "\u00a0", "euro": "€", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "pound": "£", "amp": "&"}


def strip_html(html: Column) -> Column:
    """Text without tags. The end of a block and a line break are a blank; entities are decoded once; an unclosed tag takes the rest.

    Tags are first marked by control characters, so that what they hold can't pass for an entity or a tag; those that the text has are escaped meanwhile."""
    closed = F.regexp_replace(_escaped(html), r"<[^>]*\z", "")
    marked = F.regexp_replace(closed, r"<([^>]*)>", "\u0001$1\u0002")
    blocks = "|".join(BLOCK_TAGS)
    spaced = F.regexp_replace(marked, rf"(?i)\u0001\s*(?:/\s*(?:{blocks})|br(?:[\s/][^\u0002]*)?)\s*\u0002", " ")
    bare = F.regexp_replace(spaced, "\u0001[^\u0002]*\u0002", "\u0003")
    # a numeric reference is a piece of its own, so that decoded text isn't decoded again
    pieces = F.split(F.regexp_replace(bare, "(&#[0-9]{1,9};)", "\u0001$1\u0001"), "\u0001", -1)
    decoded = F.transform(pieces, lambda p: F.when(p.rlike("^&#[0-9]{1,9};$"), _numeric(p)).otherwise(_named(p)))
    return _unescaped(F.replace(F.array_join(decoded, ""), F.lit("\u0003"), F.lit("")))


#: The marks, and the escape itself, as they stand in escaped text.
_ESCAPES = {"\u0004": "\u0004\u0008", "\u0001": "\u0004\u0005", "\u0002": "\u0004\u0006", "\u0003": "\u0004\u0007"}


def _escaped(text: Column) -> Column:
    for mark, pair in _ESCAPES.items():
        text = F.replace(text, F.lit(mark), F.lit(pair))
    return text


def _unescaped(text: Column) -> Column:
    for mark, pair in reversed(_ESCAPES.items()):
        text = F.replace(text, F.lit(pair), F.lit(mark))
    return text


def _named(piece: Column) -> Column:
    for name, char in ENTITIES.items():  # & comes last, so that nothing is decoded twice
        piece = F.replace(piece, F.lit(f"&{name};"), F.lit(char))
    return piece


def _numeric(piece: Column) -> Column:
    """The code point of &#N;, or the reference as it is. UTF-32 bytes make any code point."""
    n = F.regexp_extract(piece, "([0-9]+)", 1).cast("int")
    real = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(real, _escaped(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))).otherwise(piece)


def mail_query(label: str, after: datetime.date | None = None, before: datetime.date | None = None) -> str:
    """The search of a mailbox: UTC midnights in seconds, the first one in and the last one out."""
    seconds = lambda day: int(datetime.datetime(day.year, day.month, day.day, tzinfo=datetime.UTC).timestamp())
    return f"label:{label}" + (f" after:{seconds(after)}" if after else "") + (f" before:{seconds(before)}" if before else "")


def in_window(ts: Column, after: datetime.date | None, before: datetime.date | None) -> Column:
    """The same window as a filter."""
    out = F.lit(True)
    if after:
        out &= ts >= F.lit(f"{after} 00:00:00").cast("timestamp")
    if before:
        out &= ts < F.lit(f"{before} 00:00:00").cast("timestamp")
    return out


def poll_start(now: datetime.datetime) -> datetime.date:
    """Polls look back to the midnight of yesterday."""
    return (now.astimezone(datetime.UTC) - datetime.timedelta(days=1)).date()
