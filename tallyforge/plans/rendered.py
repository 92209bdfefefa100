"""Bills rendered from the order tables, so that the extraction can be held against the columns they came from."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = 8
#: Rows of a task, at most.
ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(price: Column) -> Column:
    return F.round(price * 100).cast("bigint")


def grouped(minor: Column, group: str, decimal: str) -> Column:
    """1.234,56 with the separators given."""
    whole = F.translate(F.format_number(F.floor(minor / 100), 0), ",", group)
    return F.concat(whole, F.lit(decimal), F.lpad((minor % 100).cast("string"), 2, "0"))


def spread(rows: DataFrame, n: int) -> DataFrame:
    """rows, of which there are about n, dealt out to tasks of ROWS, one a core at least: what is rendered from them takes much longer than their bytes tell, and isn't shuffled."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, kind, c_name, issued, due, minor."""
    given = table(spark, sf_dir, "orders")
    joined = given.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    return spread(joined, given.count()).select("o_orderkey", (F.col("o_orderkey") % KINDS).alias("kind"), "o_custkey", "c_name", day.alias("issued"), F.date_add(day, 30).alias("due"), cents(F.col("o_totalprice")).alias("minor"))


def bodies(rows: DataFrame) -> DataFrame:
    """rows with sender, sender_name, text, html: eight kinds of bill."""
    issued, due, m = F.col("issued"), F.col("due"), F.col("minor")
    on = lambda day, pattern: F.date_format(day, pattern)
    whole = F.translate(F.format_number(F.floor(m / 100), 0), ",", ".")
    texts = [
        F.concat(F.lit("Rechnungsdatum: "), on(issued, "dd.MM.yyyy"), F.lit("\nGesamtbetrag: "), grouped(m, ".", ","), F.lit(" €\nfällig am "), on(due, "dd.MM.yyyy"), F.lit("\n")),
        F.concat(F.lit("Invoice date: "), on(issued, "MMM d, yyyy"), F.lit("\nTotal: US$"), grouped(m, ",", "."), F.lit("\nDue date: "), on(due, "MMMM d, yyyy"), F.lit("\n")),
        F.concat(F.lit("Date: "), on(issued, "dd/MM/yyyy"), F.lit("\nMontant total "), grouped(m, "\u00a0", ","), F.lit(" EUR\néchéance: "), on(due, "dd/MM/yyyy"), F.lit("\n")),
        F.concat(F.lit("Fecha: "), on(issued, "yyyy-MM-dd"), F.lit("\nTotal a pagar COP "), whole, F.lit("\nvencimiento "), on(due, "yyyy-MM-dd"), F.lit("\n")),
        F.concat(F.lit("Total: $ "), grouped(m, ",", "."), F.lit("\nDue: "), on(due, "yyyy-MM-dd"), F.lit("\n")),
        F.concat(F.lit("You paid "), grouped(m, ",", "."), F.lit(" GBP on "), on(issued, "d MMMM yyyy"), F.lit(". Thank you.\n")),
        F.concat(F.lit("Contrato 44/7718\nFecha: "), on(issued, "dd/MM/yyyy"), F.lit("\nTotal: "), grouped(m, ".", ","), F.lit(" EUR\n")),
        F.lit(None).cast("string"),
    ]
    text = texts[-1]
    for k, t in enumerate(texts[:-1]):
        text = F.when(F.col("kind") == k, t).otherwise(text)
    html = F.concat(F.lit("<table><tr><td>Total</td><td><b>"), grouped(m, ".", ","), F.lit("&nbsp;&euro;</b></td></tr><tr><td>Due date</td><td>"), on(due, "yyyy-MM-dd"), F.lit("</td></tr></table>"))
    return rows.withColumns({
        "sender": F.concat(F.lit("Billing@Cust"), F.col("o_custkey").cast("string"), F.lit(".Example.COM")),
        "sender_name": F.when(F.col("kind") % 2 == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))),
        "text": text, "html": F.when(F.col("kind") == 7, html),
    })


def messages(rows: DataFrame) -> DataFrame:
    """rows with content: the bill as a message with a base64 attachment of its order key."""
    body = F.coalesce("text", "html")
    subtype = F.when(F.col("text").isNull(), "html").otherwise("plain")
    name = F.coalesce(F.concat(F.lit('"'), F.trim("sender_name"), F.lit('" ')), F.lit(""))
    content = F.concat(
        F.lit("From: "), name, F.lit("<"), F.col("sender"), F.lit(">\r\nSubject: Bill "), F.col("o_orderkey").cast("string"), F.lit("\r\nDate: "), F.date_format(F.col("issued").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit(' +0000\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="part"\r\n\r\n--part\r\nContent-Type: text/'), subtype, F.lit("; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), body,
        F.lit("\r\n--part\r\nContent-Type: Application/Octet-Stream\r\nContent-Disposition: attachment; filename=\"key.bin\"\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.col("o_orderkey").cast("string").cast("binary")), F.lit("\r\n--part--\r\n"),
    )
    return rows.withColumn("content", F.encode(content, "UTF-8"))


def invoices(rows: DataFrame) -> DataFrame:
    """rows with xml: an outer document around an Invoice in character data, with decoys outside it."""
    m = F.col("minor")
    amount = F.concat(F.floor(m / 100).cast("string"), F.lit("."), F.lpad((m % 100).cast("string"), 2, "0"))
    period = F.when(F.col("kind") % 2 == 0, F.concat(F.lit("<cac:InvoicePeriod><cbc:StartDate>"), F.col("issued").cast("string"), F.lit("</cbc:StartDate><cbc:EndDate>"), F.col("due").cast("string"), F.lit("</cbc:EndDate></cac:InvoicePeriod>"))).otherwise("")
    party = lambda tag, inner: F.concat(F.lit(f"<cac:{tag}>"), inner, F.lit(f"</cac:{tag}>"))
    named = F.when(F.col("kind") % 3 == 0, party("PartyTaxScheme", F.concat(F.lit("<cbc:RegistrationName>"), F.col("c_name"), F.lit(" &amp; Co</cbc:RegistrationName>")))).otherwise(
        F.concat(F.lit("<cac:PartyTaxScheme><cbc:RegistrationName> </cbc:RegistrationName></cac:PartyTaxScheme>"), party("PartyName", F.concat(F.lit("<cbc:Name>"), F.col("c_name"), F.lit("</cbc:Name>")))))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><AttachedDocument><cbc:IssueDate>1900-01-01</cbc:IssueDate><cac:Attachment><![CDATA[<Invoice><cbc:IssueDate>'), F.col("issued").cast("string"), F.lit("</cbc:IssueDate><cbc:DueDate>"), F.col("due").cast("string"), F.lit("T00:00</cbc:DueDate>"),
        period, F.lit("<cac:AccountingSupplierParty><cac:Party>"), named, F.lit('</cac:Party></cac:AccountingSupplierParty><cac:LegalMonetaryTotal><cbc:PayableAmount currencyID="COP">'), amount, F.lit("</cbc:PayableAmount></cac:LegalMonetaryTotal></Invoice>]]></cac:Attachment></AttachedDocument>"),
    )
    return rows.withColumn("xml", xml)


def archive(data: bytes, method: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr(zipfile.ZipInfo("folder/"), b"")
        z.writestr(zipfile.ZipInfo("folder/note.txt"), b"note")
        z.writestr(zipfile.ZipInfo("folder/bill.XML"), data, method)
    return out.getvalue()


def archives(plain: bool) -> Callable[[str], bytes]:
    """archive() of a text. All such archives are alike but for the text, its checksum and sizes, and the directory's place, so only these are made for each."""
    method = zipfile.ZIP_STORED if plain else zipfile.ZIP_DEFLATED
    empty = archive(b"", zipfile.ZIP_STORED)
    last, directory, entry = empty.rindex(b"PK\3\4"), empty.index(b"PK\1\2"), empty.rindex(b"PK\1\2")
    kind = struct.pack("<H", method)
    head, name, before, after, end = empty[: last + 8] + kind + empty[last + 10 : last + 14], empty[last + 26 : directory], empty[directory : entry + 10] + kind + empty[entry + 12 : entry + 16], empty[entry + 28 : -6], empty[-2:]

    def one(text: str) -> bytes:
        data = packed = text.encode()
        if not plain:
            deflate = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
            packed = deflate.compress(data) + deflate.flush()
        sizes = struct.pack("<3L", zlib.crc32(data), len(packed), len(data))
        return b"".join((head, sizes, name, packed, before, sizes, after, struct.pack("<L", directory + len(packed)), end))

    return one


def zipped(xml: Column, stored: Column) -> Column:
    """An archive with a folder, a note and the text."""

    def run(texts: pd.Series, plain: pd.Series) -> pd.Series:
        made = {p: archives(p) for p in (True, False)}
        return pd.Series([made[bool(s)](t) for t, s in zip(texts, plain, strict=True)])

    return F.pandas_udf(run, "binary")(xml, stored)


def bill_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table of bills: seq is the order key + 1, every seventh lacks an amount, every eleventh needs review."""
    o = orders(spark, sf_dir)
    key = F.col("o_orderkey")
    bare = key % 7 == 0
    return o.select(
        (key + 1).cast("bigint").alias("seq"), F.sha2(key.cast("string").cast("binary"), 256).alias("id"), F.unhex(F.sha2(key.cast("string").cast("binary"), 256)).alias("hash"), F.col("c_name").alias("vendor"),
        F.when(~bare, F.col("minor")).alias("amount_minor"), F.when(~bare, F.lit("EUR")).alias("currency"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"),
        "issued", F.when(key % 3 == 0, F.col("due")).alias("due"), F.when(bare | (key % 11 == 0), "needs_review").otherwise("extracted").alias("status"), F.col("issued").cast("timestamp").alias("inserted_at"),
    )
