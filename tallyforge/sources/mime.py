"""Raw messages to envelopes: headers, bodies and attachments, decoded in Arrow batches."""

from __future__ import annotations

import datetime
import email
import email.header
import functools
import re
from collections.abc import Iterator
from email.message import Message
from email.policy import compat32
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.schemas import ENVELOPE

MALFORMED, NO_SENDER = "malformed message", "missing sender"
OCTET_STREAM = "application/octet-stream"
_header = re.compile(rb"[!-9;-~]+[ \t]*:")
_mime = re.compile(r"[^\s;/\x80-\U0010ffff]+/[^\s;/\x80-\U0010ffff]+")
_blocks = re.compile(r"(?i)</(?:p|div|tr|table|li|ul|ol|h[1-6]|section|blockquote)\s*>|<br[^>]*>")


def header(value: object) -> str | None:
    """A header's text, encoded words decoded. The older message class is used, as it parses several times faster."""
    if value is None:
        return None
    text = re.sub(r"\r?\n(?=[ \t])", "", str(value))
    if "=?" not in text:
        return text
    try:
        return str(email.header.make_header(email.header.decode_header(text)))
    except (LookupError, ValueError):
        return text


def sent_at(value: object) -> datetime.datetime | None:
    try:
        return None if value is None else parsedate_to_datetime(str(value))
    except (TypeError, ValueError):
        return None


def mime_of(part: Message) -> str:
    """type/subtype in lower case; text/plain if none is stated, and a stream of bytes if it can't be used."""
    stated = part.get("Content-Type")
    if stated is None:
        return "text/plain"
    kind = str(stated).split(";", 1)[0].strip()
    return kind.lower() if _mime.fullmatch(kind) else OCTET_STREAM


def content_of(part: Message) -> bytes:
    if part.get_content_type() == "message/rfc822":
        inner = part.get_payload()
        return b"".join(p.as_bytes() for p in inner) if isinstance(inner, list) else str(inner).encode()
    return part.get_payload(decode=True) or b""


def text_of(part: Message) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace").replace("\r\n", "\n")
    except LookupError:
        return raw.decode("utf-8", "replace").replace("\r\n", "\n")


def html_as_text(html: str) -> str:
    return re.sub("<[^>]*>", "", _blocks.sub("\n", html))


def leaves(message: Message) -> Iterator[Message]:
    """Parts without parts, in document order; an attached message is one part."""
    if message.get_content_maintype() == "multipart" and message.is_multipart():
        for part in message.get_payload():
            yield from leaves(part)
    else:
        yield message


_address = re.compile(r'(?:"([^"\\\r\n]*)" |)<([A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>')


def _addresses(value: str) -> list[tuple[str, str]]:
    """Names and addresses; one in the plainest form is read at once."""
    plain = _address.fullmatch(value)
    return [(plain[1] or "", plain[2])] if plain else getaddresses([value])


def sender_of(message: Message) -> tuple[str, str | None] | None:
    for field in ("From", "Sender"):
        value = message.get(field)
        for name, address in _addresses(str(value))[:1] if value is not None else []:
            if address:
                name = (header(name) or "").strip()
                return address, name if name and name.lower() != address.lower() else None
    return None


_blank = re.compile(r"\n\r?\n")
_field = re.compile("[!-9;-~]+:")


@functools.lru_cache(1024)
def _delimiter(boundary: str) -> re.Pattern:
    return re.compile("^" + re.escape("--" + boundary) + r"(--)?[ \t]*(?:\r?\n|\Z)", re.MULTILINE)


def _simple(text: str) -> Message | None:
    """Headers and a body that isn't looked into; None if the headers aren't plain lines."""
    blank = _blank.search(text)
    if blank is None:
        return None
    message, lines = Message(compat32), []
    for line in text[: blank.start()].split("\n"):
        line += "\n"
        if line[:1] in (" ", "\t") and lines:
            lines[-1].append(line)
        elif _field.match(line):
            lines.append([line])
        else:
            return None
    for each in lines:
        message.set_raw(*compat32.header_source_parse(each))
    message.set_payload(text[blank.end() :])
    return message


def _flat(text: str) -> Message | None:
    """A message of one part, or of parts without parts between delimiters from the first line of the body on; None for what has another shape."""
    if text.count("\r") != text.count("\r\n") or (message := _simple(text)) is None:
        return None
    kind = message.get_content_type()
    if not kind.startswith("multipart/"):
        return None if kind.startswith("message/") else message
    boundary = message.get_boundary()
    if kind == "multipart/digest" or not boundary:
        return None
    body = message._payload  # as it is: get_payload() would replace what is no ASCII
    found = list(_delimiter(boundary).finditer(body))
    if len(found) < 2 or found[0].start() or [bool(f[1]) for f in found] != [False] * (len(found) - 1) + [True]:
        return None
    message._payload = None
    for one, following in zip(found, found[1:], strict=False):
        part = _simple(body[one.end() : following.start()])
        if part is None or part.get_content_maintype() in ("multipart", "message"):
            return None
        own = part._payload
        part.set_payload(own[:-2] if own.endswith("\r\n") else own.removesuffix("\n"))  # the line's end before a delimiter is the delimiter's
        message.attach(part)
    return message


def message_of(raw: bytes) -> Message:
    """What email.message_from_bytes gives, but for preambles, epilogues and defects. Its parser goes line by line, so the most common shapes are cut at their delimiters instead."""
    flat = _flat(raw.decode("ascii", "surrogateescape"))
    return email.message_from_bytes(raw) if flat is None else flat


def parse(raw: bytes) -> tuple[dict | None, str | None]:
    """The envelope, or why there is none."""
    if not _header.match(raw):
        return None, MALFORMED
    try:
        message = message_of(raw)
        sender = sender_of(message)
        if sender is None:
            return None, NO_SENDER
        text, html, documents = None, None, []
        for part in leaves(message):
            kind, attached = part.get_content_type(), part.get_content_disposition() == "attachment"
            if kind == "text/plain" and not attached and text is None:
                text = text_of(part)
            elif kind == "text/html" and not attached and html is None:
                html = text_of(part)
            else:
                documents.append({"mime": mime_of(part), "filename": header(part.get_filename()), "bytes": content_of(part)})
        if text is None and html is not None:
            text = html_as_text(html)
        return {"subject": header(message["Subject"]), "sender": sender[0], "sender_name": sender[1], "date": sent_at(message["Date"]), "text": text, "html": html, "documents": documents}, None
    except Exception as e:  # any bytes may come in; a row must not end the job
        return None, f"{MALFORMED}: {type(e).__name__}"


_envelope = pa.schema([
    ("subject", pa.string()), ("sender", pa.string()), ("sender_name", pa.string()), ("date", pa.timestamp("us", "UTC")), ("text", pa.string()), ("html", pa.string()),
    ("documents", pa.list_(pa.struct([("mime", pa.string()), ("filename", pa.string()), ("bytes", pa.binary())]))), ("error", pa.string()),
])


def _whole(text: str | None) -> str | None:
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def decode(messages: DataFrame) -> DataFrame:
    """id, hash, content of raw messages to id, hash, the envelope's columns and error. The content is dropped here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                columns: dict[str, list] = {name: [] for name in _envelope.names}
                for raw in some.column("content").to_pylist():
                    envelope, error = parse(raw or b"")
                    row = (envelope or {}) | {"error": error}
                    date = row.get("date")
                    row["date"] = date if date is None or date.tzinfo else date.replace(tzinfo=datetime.UTC)
                    for name, values in columns.items():
                        v = row.get(name)
                        values.append(_whole(v) if isinstance(v, str) else v)
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("hash"), *(pa.array(columns[f.name], f.type) for f in _envelope)], names=["id", "hash", *_envelope.names])

    return messages.select("id", "hash", "content").mapInArrow(run, f"id string, hash binary, {ENVELOPE}, error string")
