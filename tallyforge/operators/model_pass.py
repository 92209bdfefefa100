"""The second pass: a language model asked for the fields, through an injected client."""

from __future__ import annotations

import json
import shutil
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import strip_fence, strip_html
from tallyforge.functions.validate import clamped, currency, iso_date, period, vendor
from tallyforge.operators.extract import Extractor
from tallyforge.operators.merge import extraction
from tallyforge.schemas import MODEL, NOTES
from tallyforge.sources.pages import rasterize
from tallyforge.sources.pdf import PDF_TYPE, text_layer

UNAVAILABLE, MALFORMED = "LlmUnavailable", "LlmMalformed"
BODY = 20_000
REPLY = "vendor string, amount_minor_units bigint, currency string, period_start string, period_end string, issued string, due string, confidence int"
INSTRUCTIONS = "Read this bill and answer with one JSON object of the given keys; null for what is not stated. Amounts are in hundredths, dates yyyy-mm-dd, confidence 0 to 100."


class Unreachable(Exception):
    """The client could not be asked; the message keeps what else was found."""


@dataclass(frozen=True)
class Image:
    """A page as a PNG file."""

    data: bytes


@dataclass(frozen=True)
class Pdf:
    data: bytes


Part = str | Image | Pdf


class Client(Protocol):
    def complete(self, instructions: str, parts: list[Part], keys: list[str]) -> str: ...


@dataclass(frozen=True)
class Options:
    pages: int = 4
    most_confidence: int = 70
    body: int = BODY
    whole_files: bool = False
    #: Requests of a task that are under way at once; times that a bill is asked for, the seconds before the second one (each later one waits twice as long), and the seconds from which
    #: it isn't asked for again.
    at_once: int = 16
    tries: int = 3
    pause: float = 0.5
    limit: float = 120.0
    keys: list[str] = field(default_factory=lambda: [k.split()[0] for k in REPLY.split(", ")])


def body_text(text: Column, html: Column, most: int = BODY) -> Column:
    """The text, else the HTML without its tags; its first characters, as the model's window is bounded."""
    return F.substring(F.coalesce(text, strip_html(html), F.lit("")), 1, most)


def well_formed(reply: str) -> str | None:
    """The reply as plain JSON of the expected types; None if a key has another type or confidence is missing."""
    try:
        got = json.loads(reply)
    except (ValueError, RecursionError):
        return None
    if not isinstance(got, dict):
        return None
    whole = lambda v, low, high: type(v) is int and low <= v <= high
    if not whole(got.get("confidence"), 0, 255) or not (got.get("amount_minor_units") is None or whole(got["amount_minor_units"], -(2**63), 2**63 - 1)):
        return None
    names = ("vendor", "currency", "period_start", "period_end", "issued", "due")
    if any(not isinstance(got.get(n), str | None) for n in names):
        return None
    return json.dumps({n: got.get(n) for n in (*names, "amount_minor_units", "confidence")})


def map_reply(reply: Column, most: int = 70) -> Column:
    """A reply as an extraction; each bad field is left out, a bad reply is a note. One confidence, capped, for all fields."""
    checked = F.arrow_udf(lambda given: pa.array([None if r is None else well_formed(r) for r in given.to_pylist()], pa.string()), "string")
    json_ = F.from_json(checked(strip_fence(reply)), REPLY)
    confidence = clamped(F.least(json_["confidence"], F.lit(most)))
    nowhere = F.struct(F.struct(F.lit(MODEL).alias("kind"), F.lit(None).cast("int").alias("doc")).alias("source"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def of(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("value"), confidence.alias("confidence"), nowhere.alias("span")))

    money = F.when(json_["amount_minor_units"].isNotNull() & currency(json_["currency"]).isNotNull(), F.struct(json_["amount_minor_units"], json_["currency"]))
    notes = F.when(json_.isNull(), F.array(F.struct(F.lit(MALFORMED).alias("kind"), F.lit(None).cast("int").alias("document")))).otherwise(F.array().cast(NOTES))
    return extraction(notes, amount=of(money), vendor=of(vendor(json_["vendor"])), issued=of(iso_date(json_["issued"])), due=of(iso_date(json_["due"])), period=of(period(iso_date(json_["period_start"]), iso_date(json_["period_end"]))))


def drawn() -> Callable[[bytes, int], list[bytes]] | None:
    """The rasterizer, where its program is installed."""
    return rasterize if shutil.which("pdftoppm") else None


def asked(client: Client, parts: list[Part], options: Options) -> str:
    """The client's answer, asked for again while it is Unreachable and there is time."""
    began, pause = time.monotonic(), options.pause
    for nth in range(1, options.tries + 1):
        try:
            return client.complete(INSTRUCTIONS, parts, options.keys)
        except Unreachable:
            if nth == options.tries or time.monotonic() - began + pause > options.limit:
                raise
        time.sleep(pause)
        pause *= 2
    raise Unreachable("no try")


def model_extractor(client: Client, draw: Callable[[bytes, int], list[bytes]] | None = None, options: Options = Options()) -> Extractor:
    """Asks the client for each row, `at_once` rows at a time; rows with nothing to send aren't asked. Meant for the second half of escalate(). Only the body and the PDFs go to Python,
    and nothing is shuffled. draw: pages as PNG files; where the program for these is installed, it is used unless another one is given."""

    def parts_of(body: str | None, files: list[bytes]) -> list[Part]:
        pages = draw or drawn()
        parts: list[Part] = [body] if body else []
        for data in files:
            if options.whole_files:
                parts.append(Pdf(data))
            elif pages is not None:
                parts += [Image(p) for p in pages(data, options.pages)]
            layer = text_layer(data)
            parts += [layer] if layer else []
        return parts

    def ask(bodies: pa.Array, pdfs: pa.Array) -> pa.Array:
        def one(given: tuple) -> dict:
            row = dict.fromkeys(("reply", "note", "failed"))
            try:
                parts = parts_of(given[0].as_py(), given[1].as_py() or [])
                row["reply"] = asked(client, parts, options) if parts else None
            except Unreachable:
                row["note"] = UNAVAILABLE
            except Exception as e:  # a file that can't be read or drawn, or a part that the provider doesn't take, is the row's error
                row["failed"] = f"model: {e}"
            return row

        # map keeps the order of the rows
        with ThreadPoolExecutor(options.at_once) as pool:
            rows = list(pool.map(one, zip(bodies, pdfs, strict=True)))
        return pa.array(rows, pa.struct([("reply", pa.string()), ("note", pa.string()), ("failed", pa.string())]))

    def run(envelopes: DataFrame, out: str) -> DataFrame:
        files = F.transform(F.filter("documents", lambda d: d["mime"] == PDF_TYPE), lambda d: d["bytes"])
        answer = F.arrow_udf(ask, "struct<reply:string,note:string,failed:string>")(body_text(F.col("text"), F.col("html"), options.body), files)
        answered = envelopes.withColumn("_answer", answer)
        down = F.array(F.struct(F.col("_answer.note").alias("kind"), F.lit(None).cast("int").alias("document")))
        mapped = F.when(F.col("_answer.reply").isNotNull(), map_reply(F.col("_answer.reply"), options.most_confidence)).when(F.col("_answer.note") == UNAVAILABLE, extraction(down)).otherwise(extraction())
        before = F.col("error") if "error" in envelopes.columns else F.lit(None).cast("string")
        return answered.withColumns({out: mapped, "error": F.coalesce(before, "_answer.failed")}).drop("_answer")

    return run
