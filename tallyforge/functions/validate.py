"""Validated types as columns: a value, or null where it isn't valid."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.schemas import EXTRACTED, NEEDS_REVIEW

# The 171 active ISO 4217 codes.
ISO_4217 = """
AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW
CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL
HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA
MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD
RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD
USN UYI UYU UYW UZS VED VES VND VUV WST XAF XAG XAU XCD XCG XDR XOF XPD XPF XPT XSU XUA YER ZAR ZMW ZWG
""".split()

#: White space as Unicode has it, for trimming at both ends.
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def is_currency(code: Column) -> Column:
    return F.coalesce(code.isin(*ISO_4217), F.lit(False))


def currency(code: Column) -> Column:
    return F.when(code.isin(*ISO_4217), code)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def vendor(name: Column) -> Column:
    """The trimmed name, null if nothing is left."""
    return F.nullif(trimmed(name), F.lit(""))


def is_bill_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[!-~]{1,128}$") & ~text.contains("\n"), F.lit(False))


def bill_id(text: Column) -> Column:
    return F.when(is_bill_id(text), text)


def message_id(text: Column) -> Column:
    return F.when(F.length(text) > 0, text)


def mime_type(text: Column) -> Column:
    """type/subtype in lower case; null unless there is exactly one slash between ASCII halves without blanks or semicolons."""
    return F.when(text.rlike(r"^[\x00-\x08\x0E-\x1F!-.0-:<-~]+/[\x00-\x08\x0E-\x1F!-.0-:<-~]+$") & ~text.contains("\n"), F.lower(text))


def confidence(value: Column) -> Column:
    return F.when(value.between(0, 100), value.cast("int"))


def clamped(value: Column) -> Column:
    return F.least(value, F.lit(100)).cast("int")


def money(minor_units: Column, code: Column) -> Column:
    """Null unless both are there and the currency is valid."""
    return F.when(minor_units.isNotNull() & code.isin(*ISO_4217), F.struct(minor_units.cast("bigint").alias("minor_units"), code.alias("currency")))


def money_add(a: Column, b: Column) -> Column:
    """Null if the currencies differ or the sum overflows."""
    total = F.try_add(a["minor_units"], b["minor_units"])
    return F.when((a["currency"] == b["currency"]) & total.isNotNull(), F.struct(total.alias("minor_units"), a["currency"].alias("currency")))


def money_subtract(a: Column, b: Column) -> Column:
    total = F.try_subtract(a["minor_units"], b["minor_units"])
    return F.when((a["currency"] == b["currency"]) & total.isNotNull(), F.struct(total.alias("minor_units"), a["currency"].alias("currency")))


def period(start: Column, end: Column) -> Column:
    """Both ends count; null if either is missing or they are inverted."""
    return F.when(end >= start, F.struct(start.alias("start"), end.alias("end")))


def iso_date(text: Column) -> Column:
    """A strict yyyy-mm-dd."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def broken_invariant(status: Column, vendor: Column, minor: Column, code: Column, start: Column, end: Column, issued: Column) -> Column:
    """Why a flat bill row can't be a bill; null if it can. Half of an amount or of a period counts as none."""
    no_amount = minor.isNull() | code.isNull()
    no_period = start.isNull() | end.isNull()
    return (
        F.when(~F.coalesce(status.isin(EXTRACTED, NEEDS_REVIEW), F.lit(False)), "unknown status")
        .when(vendor.isNotNull() & F.coalesce(trimmed(vendor) == "", F.lit(False)), "empty vendor")
        .when(~no_amount & ~is_currency(code), "unknown currency")
        .when(~no_period & (end < start), "inverted period")
        .when((status == EXTRACTED) & (vendor.isNull() | no_amount | (no_period & issued.isNull())), "incomplete bill")
    )


def page_size(n: int = 50) -> int:
    if not 1 <= n <= 200:
        raise ValueError("a page has 1 to 200 bills")
    return n


def date_range(after: str | None = None, before: str | None = None) -> tuple[datetime.date | None, datetime.date | None]:
    """Strict dates; `after` counts and `before` doesn't, so the range must not be empty."""
    ends = []
    for text in (after, before):
        if text is not None and (len(text) != 10 or text[4] != "-" or text[7] != "-"):
            raise ValueError(f"not a yyyy-mm-dd date: {text}")
        ends.append(None if text is None else datetime.date.fromisoformat(text))
    if ends[0] and ends[1] and ends[0] >= ends[1]:
        raise ValueError("the range is empty")
    return ends[0], ends[1]
