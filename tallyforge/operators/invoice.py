"""Invoices in UBL: from zipped XML attachments to an extraction at full confidence."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import xml
from tallyforge.functions.validate import ISO_4217, trimmed
from tallyforge.operators.merge import extraction, merge_array
from tallyforge.schemas import ATTACHMENT, MONEY, NOTES, PERIOD, field
from tallyforge.sources import archive

CONFIDENCE = 100
ZIP_TYPES = ["application/zip", "application/x-zip-compressed"]
UNREADABLE = "UnreadableArchive"
_amount = re.compile(r"([0-9]+)(?:\.([0-9]{1,2}))?")
_codes = frozenset(ISO_4217)
_iso = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", re.ASCII)


def is_zip(mime, filename):
    """Archives by type, or by name where the type says nothing."""
    return F.coalesce(mime.isin(*ZIP_TYPES) | ((mime == "application/octet-stream") & F.lower(filename).endswith(".zip")), F.lit(False))


def minor_units(text: str) -> int | None:
    """Digits with at most two decimals, in hundredths; nothing else."""
    found = _amount.fullmatch(text.strip())
    if not found:
        return None
    value = int(found[1]) * 100 + int((found[2] or "").ljust(2, "0"))
    return value if int(found[1]) < 2**63 and value < 2**63 else None


def leading_date(text: str) -> datetime.date | None:
    head = text.strip()[:10]
    if not _iso.fullmatch(head):
        return None
    try:
        return datetime.date.fromisoformat(head)
    except ValueError:
        return None


_vendors = (("PartyTaxScheme", "RegistrationName"), ("PartyLegalEntity", "RegistrationName"), ("PartyName", "Name"))
_names = frozenset(["Invoice", "LegalMonetaryTotal", "PayableAmount", "IssueDate", "PaymentMeans", "PaymentDueDate", "DueDate", "InvoicePeriod", "StartDate", "EndDate", "AccountingSupplierParty", "Party", *(n for pair in _vendors for n in pair)])


def pluck(text: str) -> dict | None:
    """The fields of the first Invoice, each (value..., start, end); None if there is no invoice."""
    if "Invoice" not in text:
        return None
    document = xml.Document(text, _names)
    if document.find([], "Invoice") is None:
        return None
    out: dict = dict.fromkeys(("amount", "issued", "due", "period", "vendor"))
    payable = document.find(["Invoice", "LegalMonetaryTotal"], "PayableAmount")
    if payable is not None and (n := minor_units(payable.text)) is not None and (code := xml.attribute(payable, "currencyID")) in _codes:
        out["amount"] = {"minor_units": n, "currency": code, "start": payable.start, "end": payable.end}

    def dated(parents: list[str], name: str) -> dict | None:
        element = document.find(parents, name)
        day = element and leading_date(element.text)
        return {"value": day, "start": element.start, "end": element.end} if day else None

    out["issued"] = dated(["Invoice"], "IssueDate")
    out["due"] = dated(["Invoice", "PaymentMeans"], "PaymentDueDate") or dated(["Invoice"], "DueDate")
    first, last = (dated(["Invoice", "InvoicePeriod"], name) for name in ("StartDate", "EndDate"))
    if first and last and last["value"] >= first["value"]:
        out["period"] = {"from": first["value"], "to": last["value"], "start": first["start"], "end": last["end"]}
    for parent, name in _vendors:
        element = document.find(["Invoice", "AccountingSupplierParty", "Party", parent], name)
        if element is not None and element.text.strip():
            out["vendor"] = {"value": element.text.strip(), "start": element.start, "end": element.end}
            break
    return out


_span = [("start", pa.int32()), ("end", pa.int32())]
_types = {
    "amount": pa.struct([("minor_units", pa.int64()), ("currency", pa.string()), *_span]), "issued": pa.struct([("value", pa.date32()), *_span]), "due": pa.struct([("value", pa.date32()), *_span]),
    "period": pa.struct([("from", pa.date32()), ("to", pa.date32()), *_span]), "vendor": pa.struct([("value", pa.string()), *_span]),
}
_ddl = "array<struct<doc:int,status:string,amount:struct<minor_units:bigint,currency:string,start:int,end:int>,issued:struct<value:date,start:int,end:int>,due:struct<value:date,start:int,end:int>,period:struct<`from`:date,`to`:date,start:int,end:int>,vendor:struct<value:string,start:int,end:int>>>"
_schema = pa.list_(pa.struct([("doc", pa.int32()), ("status", pa.string()), *_types.items()]))


def read_archive(doc: int, content: bytes) -> dict:
    """doc, status and the plucked fields of an archive's first invoice."""
    row, found = {"doc": doc, "status": "none"}, None
    try:
        for name, data in archive.entries(content):
            if name.lower().endswith(".xml") and (found := pluck(data.decode("utf-8", "replace"))):
                row["status"] = "invoice"
                break
    except archive.Unsupported:
        row["status"] = "unsupported"
    except archive.Malformed as e:
        row["status"] = f"malformed: {e}"
    return row | (found or dict.fromkeys(_types))


def read_archives(zips: pa.Array) -> pa.Array:
    values = zips.values  # of all rows; offsets tell whose they are
    docs, contents = values.field("doc").to_pylist(), values.field("bytes")
    at = zips.offsets.to_pylist()
    return pa.array([[read_archive(docs[i], contents[i].as_py() or b"") for i in range(at[n], at[n + 1])] if zips.null_count == 0 or zips[n].is_valid else [] for n in range(len(zips))], _schema)


def archives(documents: Column) -> Column:
    """doc, status and plucked fields of each zip attachment. Only archives go to Python, and nothing is shuffled."""
    numbered = F.transform(documents, lambda d, i: F.struct(i.cast("int").alias("doc"), d["mime"].alias("mime"), d["filename"].alias("filename"), d["bytes"].alias("bytes")))
    zips = F.transform(F.filter(numbered, lambda d: is_zip(d["mime"], d["filename"])), lambda d: F.struct(d["doc"].alias("doc"), d["bytes"].alias("bytes")))
    return F.arrow_udf(read_archives, _ddl)(zips)


def xml_extractor(envelopes: DataFrame, out: str) -> DataFrame:
    """An unsupported archive is a note, a broken one an error; what holds no invoice counts for nothing."""

    def found(read: Column) -> Column:
        kind = F.struct(F.lit(ATTACHMENT).alias("kind"), read["doc"].alias("doc"))

        def own(name: str, value: Callable[[Column], Column], ddl: str) -> Column:
            c = read[name]
            return F.when(c.isNotNull(), F.struct(value(c).alias("value"), F.lit(CONFIDENCE).alias("confidence"), F.struct(kind.alias("source"), c["start"].alias("start"), c["end"].alias("end")).alias("span"))).cast(field(ddl))

        note = F.when(read["status"] == "unsupported", F.array(F.struct(F.lit(UNREADABLE).alias("kind"), read["doc"].alias("document")))).otherwise(F.array().cast(NOTES))
        return extraction(
            note, amount=own("amount", lambda c: F.struct(c["minor_units"].alias("minor_units"), c["currency"].alias("currency")), MONEY), issued=own("issued", lambda c: c["value"], "date"), due=own("due", lambda c: c["value"], "date"),
            period=own("period", lambda c: F.struct(c["from"].alias("start"), c["to"].alias("end")), PERIOD), vendor=own("vendor", lambda c: trimmed(c["value"]), "string"),
        )

    read = envelopes.withColumn("_read", archives(F.col("documents"))).withColumn("_each", F.transform("_read", found))
    broken = F.get(F.filter("_read", lambda r: r["status"].startswith("malformed")), F.lit(0))
    error = F.when(broken.isNotNull(), F.format_string("zip attachment %d: %s", broken["doc"], broken["status"]))
    before = F.col("error") if "error" in envelopes.columns else F.lit(None).cast("string")
    return read.withColumns({out: merge_array(F.col("_each")), "error": F.coalesce(before, error)}).drop("_read", "_each")
