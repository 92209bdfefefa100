"""The types that flow through the extraction, as DDL."""

from __future__ import annotations

MONEY = "struct<minor_units:bigint,currency:string>"
PERIOD = "struct<start:date,end:date>"
#: kind: 0 text, 1 HTML, 2 attachment (doc is its index), 3 model; the order settles ties.
SOURCE = "struct<kind:int,doc:int>"
SPAN = f"struct<source:{SOURCE},start:int,end:int>"
DOCUMENT = "struct<mime:string,filename:string,bytes:binary>"
NOTE = "struct<kind:string,document:int>"
NOTES = f"array<{NOTE}>"

TEXT, HTML, ATTACHMENT, MODEL = range(4)
FIELDS = {"amount": MONEY, "issued": "date", "due": "date", "period": PERIOD, "vendor": "string"}


def field(value: str) -> str:
    return f"struct<value:{value},confidence:int,span:{SPAN}>"


EXTRACTION = "struct<" + ",".join(f"{name}:{field(kind)}" for name, kind in FIELDS.items()) + f",notes:{NOTES}>"
ENVELOPE = f"subject string, sender string, sender_name string, date timestamp, text string, html string, documents array<{DOCUMENT}>"

#: seq is the order of insertion; hash is unique, and id is too.
BILLS = "seq bigint, id string, hash binary, vendor string, amount_minor bigint, currency string, period_start date, period_end date, issued date, due date, status string, inserted_at timestamp"
BILL_COLUMNS = ["vendor", "amount_minor", "currency", "period_start", "period_end", "issued", "due", "status"]
EXTRACTED, NEEDS_REVIEW = "extracted", "needs_review"
