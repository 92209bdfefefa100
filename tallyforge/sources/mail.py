"""A mailbox as a Spark data source, in batch or as a stream: executors list the ids of a day in pages and fetch its messages.

In batch, the window comes from the options or from filters on `day` and `label`, which reach the mailbox's query. As a stream, an offset is the second up to
which messages were taken, so that a restart goes on where it stopped."""

from __future__ import annotations

import base64
import datetime
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tallyforge.functions.text import mail_query, poll_start
from tallyforge.functions.validate import date_range
from tallyforge.sources.config import MissingSetting, mail_settings

PAGE = 500
API = "https://gmail.googleapis.com/gmail/v1/users/me/messages"
TOKEN = "https://oauth2.googleapis.com/token"
#: Seconds before its end from which a token isn't used any more.
EARLY = 60
#: Seconds that a stream leaves a message to appear in the mailbox's lists.
DELAY = 60
SCHEMA = "message_id string, day date, label string, content binary, error string"


class AuthError(Exception):
    """The mailbox refused the credentials."""


class TransportError(Exception):
    """The mailbox could not be reached, or answered with an error."""


class MalformedReply(Exception):
    """The answer isn't what it should be."""


class Message(NamedTuple):
    content: bytes
    #: When the mailbox got it; None if it doesn't say.
    received: datetime.datetime | None


class Mailbox(Protocol):
    def list(self, query: str, page: str | None) -> tuple[list[str], str | None]: ...

    def fetch(self, id: str) -> Message: ...


def _utc(seconds: float) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC)


class FolderMailbox:
    """A folder of .eml files as a mailbox; a message is of the time when its file was last changed, and labels are ignored. For replays and tests."""

    def __init__(self, folder: str, page: int = PAGE) -> None:
        self.folder, self.page = folder, page

    def list(self, query: str, page: str | None) -> tuple[list[str], str | None]:
        ends = {side: int(at) for side, at in re.findall(r"\b(after|before):(\d+)", query)}
        names = sorted(p.name for p in Path(self.folder).glob("*.eml") if ends.get("after", 0) <= p.stat().st_mtime < ends.get("before", 1 << 62))
        at = int(page or 0)
        return names[at : at + self.page], str(at + self.page) if at + self.page < len(names) else None

    def fetch(self, id: str) -> Message:
        path = Path(self.folder) / id
        return Message(path.read_bytes(), _utc(path.stat().st_mtime))


class RestMailbox:
    """The REST interface of a web mailbox. send(method, url, headers, body) -> (status, body) can be replaced for tests."""

    def __init__(self, client_id: str, secret: str, refresh: str, send: Callable[[str, str, dict, bytes | None], tuple[int, bytes]] | None = None, clock: Callable[[], float] = time.time) -> None:
        self.credentials = {"client_id": client_id, "client_secret": secret, "refresh_token": refresh, "grant_type": "refresh_token"}
        self.send, self.clock = send or _send, clock
        self._token: tuple[str, float] | None = None

    def token(self) -> str:
        """Kept until shortly before it ends."""
        if self._token is None or self.clock() >= self._token[1]:
            status, body = self.send("POST", TOKEN, {"Content-Type": "application/x-www-form-urlencoded"}, urllib.parse.urlencode(self.credentials).encode())
            if status in (400, 401):
                raise AuthError(str(status))
            if not 200 <= status < 300:
                raise TransportError(str(status))
            reply = _json(body)
            try:
                self._token = reply["access_token"], self.clock() + reply["expires_in"] - EARLY
            except (KeyError, TypeError) as e:
                raise MalformedReply("token") from e
        return self._token[0]

    def get(self, url: str) -> dict:
        status, body = self.send("GET", url, {"Authorization": f"Bearer {self.token()}"}, None)
        if status in (401, 403):
            raise AuthError(str(status))
        if not 200 <= status < 300:
            raise TransportError(str(status))
        return _json(body)

    def list(self, query: str, page: str | None) -> tuple[list[str], str | None]:
        asked = {"q": query, "maxResults": PAGE} | ({"pageToken": page} if page else {})
        reply = self.get(f"{API}?{urllib.parse.urlencode(asked, quote_via=urllib.parse.quote)}")
        ids = [m.get("id") for m in reply.get("messages", [])]
        if not all(ids):
            raise MalformedReply("message without an id")
        return ids, reply.get("nextPageToken") or None

    def fetch(self, id: str) -> Message:
        reply = self.get(f"{API}/{urllib.parse.quote(id, safe='')}?format=raw")
        raw, at = reply.get("raw"), str(reply.get("internalDate") or "")
        try:
            return Message(base64.urlsafe_b64decode(raw.rstrip("=") + "=" * (-len(raw.rstrip("=")) % 4)), _utc(int(at) / 1000) if at.isdecimal() else None)
        except (AttributeError, ValueError) as e:
            raise MalformedReply("raw message") from e


def _json(body: bytes) -> dict:
    try:
        reply = json.loads(body)
    except ValueError as e:
        raise MalformedReply("not JSON") from e
    if not isinstance(reply, dict):
        raise MalformedReply("not an object")
    return reply


def _send(method: str, url: str, headers: dict, body: bytes | None) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=60) as reply:
            return reply.status, reply.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except OSError as e:
        raise TransportError(str(e)) from e


def all_ids(mailbox: Mailbox, query: str) -> list[str]:
    """Every page, before any message is fetched."""
    ids, page = mailbox.list(query, None)
    while page:
        more, page = mailbox.list(query, page)
        ids += more
    return ids


class Window(InputPartition):
    """Messages of a query, all of one label; day: if they are of one."""

    def __init__(self, query: str, label: str = "", day: datetime.date | None = None) -> None:
        self.query, self.label, self.day = query, label, day


def seconds_query(label: str, after: int, before: int) -> str:
    return " ".join([*([f"label:{label}"] if label else []), f"after:{after}", f"before:{before}"])


def fetched(mailbox: Mailbox, id: str) -> tuple[Message | None, str | None]:
    """The message, or what it failed with. Refused credentials end the job."""
    try:
        return mailbox.fetch(id), None
    except (TransportError, MalformedReply) as e:
        return None, f"{type(e).__name__}: {e}"


def taken(mailbox: Mailbox, window: Window, contents: bool) -> Iterator[tuple]:
    """Rows of the window's messages."""
    for id in all_ids(mailbox, window.query):
        message, error = fetched(mailbox, id) if contents else (None, None)
        received = message.received.date() if message and message.received else None
        yield id, window.day or received, window.label, message.content if message else None, error


class Reader(DataSourceReader):
    """A partition for each day and label, whose task lists and fetches it; what one message fails with is its row's error. A window without an end goes up to today, and a last
    partition has what comes after; one without a start has one partition for all before."""

    def __init__(self, mailbox: Mailbox, label: str, after: datetime.date | None, before: datetime.date | None, contents: bool = True, today: datetime.date | None = None) -> None:
        self.mailbox, self.labels, self.after, self.before, self.contents, self.today = mailbox, [label], after, before, contents, today

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of `day` and values of `label` narrow what is listed. Spark applies all filters again."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("day",) and isinstance(value, datetime.date):
                one = datetime.timedelta(days=1)
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.after = max(filter(None, (self.after, value + one if isinstance(f, GreaterThan) else value)))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.before = min(filter(None, (self.before, value if isinstance(f, LessThan) else value + one)))
            elif column == ("label",) and isinstance(f, EqualTo | In):
                asked = [value] if isinstance(f, EqualTo) else [v for v in value if isinstance(v, str)]
                self.labels = sorted(set(asked)) if self.labels == [""] else [x for x in self.labels if x in asked]
            yield f

    def partitions(self) -> list[Window]:
        return [w for label in self.labels for w in self._days(label)]

    def _days(self, label: str) -> list[Window]:
        after, before, one = self.after, self.before, datetime.timedelta(days=1)
        if not after:
            return [Window(mail_query(label, None, before), label)]
        last = before or max(after, self.today or datetime.datetime.now(datetime.UTC).date())
        days = [after + one * n for n in range((last - after).days)]
        ended = [Window(mail_query(label, day, day + one), label, day) for day in days]
        return ended if before else [*ended, Window(mail_query(label, last, None), label)]

    def read(self, partition: Window) -> Iterator[tuple]:
        return taken(self.mailbox, partition, self.contents)


class StreamReader(DataSourceStreamReader):
    """Offsets are {"until": seconds}: a batch has the messages received from one up to the next, which is DELAY seconds behind the clock. overlap: seconds before its start that each batch
    lists again, for messages that appeared late."""

    def __init__(self, mailbox: Mailbox, label: str, after: datetime.date | None, contents: bool, overlap: int, until: int | None, clock: Callable[[], float] = time.time) -> None:
        self.mailbox, self.label, self.after, self.contents, self.overlap, self.until, self.clock = mailbox, label, after, contents, overlap, until, clock

    def initialOffset(self) -> dict:
        first = self.after or poll_start(_utc(self.clock()))
        return {"until": int(datetime.datetime(first.year, first.month, first.day, tzinfo=datetime.UTC).timestamp())}

    def latestOffset(self) -> dict:
        now = int(self.clock()) - DELAY if self.until is None else self.until
        return {"until": max(now, self.initialOffset()["until"])}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        """A partition for each day of UTC that the batch touches."""
        first, last, day = start["until"] - (self.overlap if start["until"] < end["until"] else 0), end["until"], 86_400
        cuts = [first, *range((first // day + 1) * day, last, day), last]
        return [Window(seconds_query(self.label, a, b), self.label, _utc(a).date()) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: Window) -> Iterator[tuple]:
        return taken(self.mailbox, partition, self.contents)


def mailbox_of(options: dict[str, str]) -> tuple[Mailbox, str]:
    """The mailbox that the options or the driver's environment name, and its label."""
    if "folder" in options:
        return FolderMailbox(options["folder"], int(options.get("page", PAGE))), options.get("label", "")
    settings = mail_settings(os.environ.get)
    if settings is None:
        raise MissingSetting("MAIL_CLIENT_ID")
    return RestMailbox(settings.client_id, settings.secret, settings.refresh), options.get("label", settings.label)


class MailSource(DataSource):
    """spark.read or spark.readStream, format("mailbox"), with the options label, after and before (days; before doesn't count), folder for a folder of files, and contents ("false": ids
    only). Streams take overlap, and until (seconds) for a replay that ends. Credentials come from the driver's environment, never from options, as plans show these."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def _contents(self) -> bool:
        return self.options.get("contents", "true").lower() != "false"

    def reader(self, schema) -> Reader:
        after, before = date_range(self.options.get("after"), self.options.get("before"))
        return Reader(*mailbox_of(self.options), after, before, self._contents())

    def streamReader(self, schema) -> StreamReader:
        after, _ = date_range(self.options.get("after"), None)
        until = self.options.get("until")
        return StreamReader(*mailbox_of(self.options), after, self._contents(), int(self.options.get("overlap", 0)), None if until is None else int(until))


def with_contents(listed: DataFrame, **options: str) -> DataFrame:
    """Listed messages (ids without contents) with their content or error; each is fetched by its row's task."""
    mailbox, _ = mailbox_of(options)

    def fetch(ids: pa.Array) -> pa.Array:
        rows = []
        for id in ids.to_pylist():
            message, error = fetched(mailbox, id)
            rows.append({"content": message and message.content, "error": error})
        return pa.array(rows, pa.struct([("content", pa.binary()), ("error", pa.string())]))

    got = listed.withColumn("_got", F.arrow_udf(fetch, "struct<content:binary,error:string>")("message_id"))
    return got.withColumns({"content": F.col("_got.content"), "error": F.coalesce("error", "_got.error")}).drop("_got")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)
