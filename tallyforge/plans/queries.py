"""A query for each operator over the driver's tables, and SQL with the same rows."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text, validate
from tallyforge.functions.scan import anchored, minor_units, scan
from tallyforge.operators import bills, model_pass
from tallyforge.operators.extract import bill_rows, escalate, text_extractor, vendor_of
from tallyforge.operators.invoice import is_zip, xml_extractor
from tallyforge.operators.merge import extraction, is_complete, merge_rows
from tallyforge.plans import rendered
from tallyforge.plans.rendered import table
from tallyforge.schemas import TEXT
from tallyforge.sources import archive, mime
from tallyforge.sources.shared import shared_dir
from tallyforge.sources.tables import BillTable, among

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


#: What the rendered bills say, from the columns they were made of.
FACTS = """
facts AS (
  SELECT o_orderkey, o_orderkey % 8 AS kind, o_custkey, c_name, CAST(o_orderdate AS DATE) AS issued_on, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due_on,
         CAST(round(o_totalprice * 100) AS BIGINT) AS minor
  FROM orders JOIN customer ON o_custkey = c_custkey),
told AS (
  SELECT o_orderkey, kind, c_name, o_custkey,
         CASE WHEN kind = 4 THEN NULL WHEN kind = 3 THEN (minor // 100) * 100 ELSE minor END AS amount_minor,
         CASE kind WHEN 1 THEN 'USD' WHEN 3 THEN 'COP' WHEN 4 THEN NULL WHEN 5 THEN 'GBP' ELSE 'EUR' END AS currency,
         CASE kind WHEN 4 THEN NULL WHEN 5 THEN 40 ELSE 90 END AS amount_confidence,
         CASE WHEN kind IN (4, 7) THEN NULL ELSE issued_on END AS issued,
         CASE WHEN kind IN (4, 7) THEN NULL WHEN kind = 5 THEN 40 ELSE 90 END AS issued_confidence,
         CASE WHEN kind IN (5, 6) THEN NULL ELSE due_on END AS due,
         CASE WHEN kind % 2 = 0 THEN c_name ELSE 'cust' || o_custkey || '.example.com' END AS vendor
  FROM facts)"""
BILLS = """
held AS (
  SELECT o_orderkey + 1 AS seq, sha256(CAST(o_orderkey AS VARCHAR)) AS id, c_name AS vendor,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS amount_minor, CASE WHEN o_orderkey % 7 <> 0 THEN 'EUR' END AS currency,
         CAST(o_orderdate AS DATE) AS issued, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) END AS due,
         CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'needs_review' ELSE 'extracted' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SHOWN = ["seq", "id", "vendor", "amount_minor", "currency", "issued", "due", "status"]


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendered.bodies(rendered.orders(spark, sf_dir))
    hashed = rows.withColumn("hash", text.raw_hash(F.col("o_orderkey").cast("string").cast("binary")))
    return hashed.select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", "hash", "sender", "sender_name", "text", "html")


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered.bill_table(spark, sf_dir)


def _stored(spark: SparkSession, sf_dir: str) -> BillTable:
    """The bills as a table of their own in the shared folder."""
    made = BillTable(spark, f"{shared_dir(spark)}/bills/{uuid.uuid4().hex}")
    made.write(_bills(spark, sf_dir))
    return made


# The scanner


@query(f"WITH {FACTS} SELECT o_orderkey, vendor, amount_minor, currency, issued, due, CASE WHEN kind IN (0, 1, 2, 3, 6) THEN 'extracted' ELSE 'needs_review' END AS status FROM told")
def bill_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bill_rows(text_extractor(_envelopes(spark, sf_dir), "extraction"))
    return found.select(F.col("id").cast("bigint").alias("o_orderkey"), "vendor", "amount_minor", "currency", "issued", "due", "status")


@query(f"WITH {FACTS} SELECT o_orderkey, amount_minor, currency, amount_confidence FROM told WHERE kind <> 7")
def extract_amount_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_envelopes(spark, sf_dir).where("text IS NOT NULL"), "text", "found", TEXT)
    return found.select("o_orderkey", F.col("found.amount.value.minor_units").alias("amount_minor"), F.col("found.amount.value.currency").alias("currency"), F.col("found.amount.confidence").alias("amount_confidence"))


@query(f"WITH {FACTS} SELECT o_orderkey, issued, issued_confidence, due FROM told WHERE kind <> 7")
def extract_dates_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_envelopes(spark, sf_dir).where("text IS NOT NULL"), "text", "found", TEXT)
    return found.select("o_orderkey", F.col("found.issued.value").alias("issued"), F.col("found.issued.confidence").alias("issued_confidence"), F.col("found.due.value").alias("due"))


@query(f"WITH {FACTS} SELECT o_orderkey, vendor, 20 AS confidence FROM told")
def extract_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _envelopes(spark, sf_dir).withColumn("v", vendor_of(F.col("sender"), F.col("sender_name")))
    return found.select("o_orderkey", F.col("v.value").alias("vendor"), F.col("v.confidence").alias("confidence"))


@query("""
WITH spans AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS m FROM orders),
shown AS (SELECT o_orderkey, format('{:,}', m // 100) || '.' || printf('%02d', m % 100) AS t FROM spans)
SELECT o_orderkey, strlen('Énergie — total: ') AS span_start, strlen('Énergie — total: ') + strlen(t) + 4 AS span_end, 0 AS source_kind FROM shown""")
def span_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rendered.orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("Énergie — total: "), rendered.grouped(F.col("minor"), ",", "."), F.lit(" € net")).alias("text"))
    span = F.col("found.amount.span")
    return scan(o, "text", "found", TEXT).select("o_orderkey", span["start"].cast("bigint").alias("span_start"), span["end"].cast("bigint").alias("span_end"), span["source"]["kind"].alias("source_kind"))


@query("""
SELECT o_orderkey, shape, CAST(o_orderdate AS DATE) AS day FROM orders, (VALUES (0), (1), (2), (3), (4), (5)) s(shape)""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    patterns = ["yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy"]
    shapes = F.array(*[F.struct(F.lit(i).alias("shape"), F.concat(F.lit("on "), F.upper(F.date_format(day, p)) if i == 3 else F.date_format(day, p), F.lit(".")).alias("text")) for i, p in enumerate(patterns)])
    given = table(spark, sf_dir, "orders")
    o = rendered.spread(given, given.count() * len(patterns)).select("o_orderkey", F.explode(shapes).alias("s")).select("o_orderkey", "s.shape", "s.text")
    return scan(o, "text", "found", TEXT).select("o_orderkey", "shape", F.col("found.issued.value").alias("day"))


@query("""
WITH m AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS m FROM orders)
SELECT o_orderkey, CASE WHEN k < 3 THEN m WHEN k = 3 THEN m // 10 * 100 WHEN k = 6 THEN CASE WHEN m // 100 < 92233720368 THEN (m // 100 * 1000000 + 5678) * 100 + 90 END ELSE m // 100 * 100 END AS minor FROM m""")
def amount_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' prices as numerals: with either decimal separator, one decimal (which counts as a group), groups only, no groups, and more digits than fit."""
    m, k = F.col("minor"), F.col("o_orderkey") % 7
    whole = F.floor(m / 100)
    shapes = [
        rendered.grouped(m, ".", ","), rendered.grouped(m, ",", "."), rendered.grouped(m, "\u00a0", "."), F.concat(whole.cast("string"), F.lit("."), F.floor(m % 100 / 10).cast("string")),
        F.translate(F.format_number(whole, 0), ",", "."), F.lpad(whole.cast("string"), 12, "0"), F.concat(whole.cast("string"), F.lit("005678.90")),
    ]
    numeral = F.get(F.array(*shapes), k.cast("int"))
    return rendered.orders(spark, sf_dir).select("o_orderkey", minor_units(numeral).alias("minor"))


#: A text around a numeral, and the currency that it has by its markers.
_MARKED = [
    ("COP$ {}", "COP"), ("US${}", "USD"), ("$ {} USD", "USD"), ("$ {}", None), ("EUR {} THE", None), ("5USD {}", "USD"), ("{} USD5", "USD"), ("éUS$ {}", None), ("A€ {}", "EUR"), ("XXX {}", None), ("{} £", "GBP"),
    ("AUS$ {}", None), ("{} USD$", "USD"), ("total {} EUR and 1 EUR", "EUR"), ("{} EUR then 9 GBP", "EUR"),
]


@query(f"""
WITH m AS (SELECT o_orderkey, o_orderkey % {len(_MARKED)} AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS m FROM orders), g AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {'NULL' if c is None else repr(c)})" for i, (_, c) in enumerate(_MARKED)) + """) g(k, currency))
SELECT o_orderkey, CASE WHEN k IN (5, 6) THEN 500 WHEN currency IS NOT NULL THEN m END AS minor, currency FROM m JOIN g USING (k)""")
def currency_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' prices among markers of currencies; where a marker stands at a 5 without a blank, the 5 has it."""
    before, after = (F.get(F.array(*[F.lit(t.split("{}")[side]) for t, _ in _MARKED]), (F.col("o_orderkey") % len(_MARKED)).cast("int")) for side in (0, 1))
    each = rendered.orders(spark, sf_dir).select("o_orderkey", F.concat(before, rendered.grouped(F.col("minor"), "", "."), after).alias("body"))
    return scan(each, "body", "found", TEXT).select("o_orderkey", F.col("found.amount.value.minor_units").alias("minor"), F.col("found.amount.value.currency").alias("currency"))


@query("""
WITH sent AS (SELECT event_id, user_id, ts, event_type, value FROM events),
near AS (
  SELECT a.event_id, b.event_id AS hit, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) AS n
  FROM sent a JOIN sent b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 40 MINUTE)
SELECT event_id, hit FROM near WHERE n = 1""")
def range_anchor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor window over rows: for each error the user's first click within 40 minutes. An error meets the clicks of its own 40 minutes and of the next ones, each as one array."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("int")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds.alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.floor(seconds / (40 * 60)).alias("slot"))
    errors = e.where("event_type = 'error'").select("user_id", "event_id", "micros", F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    clicks = e.where("event_type = 'click'").groupBy("user_id", "slot").agg(F.sort_array(F.collect_list(F.struct("micros", F.col("event_id").alias("hit")))).alias("clicks"))
    met = errors.join(clicks, ["user_id", "slot"])
    relative = F.transform("clicks", lambda c: F.struct((c["micros"] - F.col("micros")).alias("start"), c["hit"].alias("hit")))
    hit = anchored(F.array(F.lit(0).cast("bigint")), relative, 40 * 60 * 1_000_000)
    return met.select("event_id", hit.alias("found")).where("found IS NOT NULL").groupBy("event_id").agg(F.min("found").alias("first")).select("event_id", F.col("first.hit").alias("hit"))


_CLOSERS = "|".join(text.BLOCK_TAGS)


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '<[^>]*\z', '') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?i)<\s*/\s*({_CLOSERS})\s*>|<\s*br([\s/][^>]*)?>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '<[^>]*>', '', 'g') AS t FROM b)
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&euro;', '€'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&pound;', '£'), '&amp;', '&') AS stripped FROM c""")
def strip_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("stripped"))


# Validated types


@query("SELECT code, count(*) AS n, code IN (" + ", ".join(f"'{c}'" for c in validate.ISO_4217) + ") AS valid FROM (SELECT upper(unnest(regexp_extract_all(text, '[A-Za-z]{3}'))) AS code FROM documents) GROUP BY code")
def currency_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three letters in a row of the whole texts, and how often they stand there."""
    codes = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3}"), F.lit(0))).alias("letters")).select(F.upper("letters").alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n")).withColumn("valid", validate.is_currency(F.col("code")))


def _money_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    big = F.when(F.col("l_linenumber") == 7, F.lit(9223372036854775807)).otherwise(rendered.cents(F.col("l_extendedprice")))
    other = F.when(F.col("l_returnflag") == "R", "USD").otherwise("EUR")
    return line.select(
        F.struct(big.alias("minor_units"), F.lit("EUR").alias("currency")).alias("a"), F.struct(rendered.cents(F.col("l_quantity")).alias("minor_units"), other.alias("currency")).alias("b"),
        *[F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
    )


_PAIRS = """
WITH pairs AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 9223372036854775807 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS a, CAST(round(l_quantity * 100) AS BIGINT) AS b, l_returnflag <> 'R' AS same
  FROM lineitem)"""


@query(_PAIRS + "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN same AND l_linenumber <> 7 THEN a + b WHEN same AND b = 0 THEN a END AS total FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 0 ELSE a END AS a, b, same FROM pairs)")
def money_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of one currency; overflow and other currencies give null."""
    return _money_pairs(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", validate.money_add(F.col("a"), F.col("b"))["minor_units"].alias("total"))


@query(_PAIRS + "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN same THEN a - b END AS rest FROM pairs")
def money_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_pairs(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", validate.money_subtract(F.col("a"), F.col("b"))["minor_units"].alias("rest"))


@query("""
WITH ends AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem GROUP BY l_orderkey),
turned AS (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN lo ELSE hi END AS a, CASE WHEN l_orderkey % 2 = 0 THEN hi ELSE lo END AS b FROM ends)
SELECT l_orderkey, CASE WHEN b >= a THEN a END AS period_start, CASE WHEN b >= a THEN b END AS period_end FROM turned""")
def period_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi"))
    even = F.col("l_orderkey") % 2 == 0
    p = validate.period(F.when(even, F.col("lo")).otherwise(F.col("hi")), F.when(even, F.col("hi")).otherwise(F.col("lo")))
    return ends.select("l_orderkey", p["start"].alias("period_start"), p["end"].alias("period_end"))


@query("""
WITH b AS (
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'paid' WHEN 1 THEN 'needs_review' ELSE 'extracted' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'v' END AS vendor,
         CASE WHEN o_orderkey % 4 <> 0 THEN 1 END AS minor, CASE o_orderkey % 6 WHEN 0 THEN 'XXX' ELSE 'EUR' END AS code FROM orders)
SELECT o_orderkey, CASE WHEN status = 'paid' THEN 'unknown status' WHEN vendor = ' ' THEN 'empty vendor' WHEN minor IS NOT NULL AND code = 'XXX' THEN 'unknown currency'
  WHEN o_orderkey % 17 = 0 THEN 'inverted period' WHEN status = 'extracted' AND (vendor IS NULL OR minor IS NULL) THEN 'incomplete bill' END AS reason FROM b""")
def bill_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "paid").when(k % 5 == 1, "needs_review").otherwise("extracted")
    vendor = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 13 == 0, " ").otherwise("v")
    day = F.lit(datetime.date(2026, 1, 2))
    reason = validate.broken_invariant(status, vendor, F.when(k % 4 != 0, F.lit(1).cast("bigint")), F.when(k % 6 == 0, "XXX").otherwise("EUR"), day, F.when(k % 17 == 0, F.lit(datetime.date(2026, 1, 1))).otherwise(day), F.lit(None).cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query(r"SELECT doc_id, regexp_full_match(text, '[!-~]{1,128}') AS valid FROM documents UNION ALL SELECT o_orderkey, length(sha256(CAST(o_orderkey AS VARCHAR)) || '-' || repeat('x', CAST(o_orderkey % 80 AS INTEGER))) <= 128 FROM orders")
def bill_id_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, and ids of 65 to 144 characters made for orders."""
    made = F.concat(F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit("-"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 80).cast("int")))
    ids = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("id")).unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), made.alias("id")))
    return ids.select("doc_id", validate.is_bill_id(F.col("id")).alias("valid"))


@query(r"""
WITH g AS (SELECT doc_id, doc_id % 6 AS k, coalesce(source, 'x') AS s, coalesce(lang, 'y') AS l, text FROM documents)
SELECT doc_id, CASE WHEN k < 2 THEN lower(s || '/x-' || l) END AS mime, lower(CASE WHEN regexp_full_match(text, '[!-.0-:<-~]+/[!-.0-:<-~]+') THEN text END) AS of_text FROM g""")
def mime_type_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types made of the documents' sources and languages, with a second slash, a blank, a parameter or an empty half in four of six, and their whole texts."""
    s, lang = F.coalesce("source", F.lit("x")), F.coalesce("lang", F.lit("y"))
    shapes = [F.concat(s, F.lit("/x-"), lang), F.upper(F.concat(s, F.lit("/x-"), lang)), F.concat(s, F.lit("/"), lang, F.lit("/z")), F.concat(s, F.lit(" /"), lang), F.concat(s, F.lit("/"), lang, F.lit("; charset=utf-8")), F.concat(s, F.lit("/"))]
    given = F.get(F.array(*shapes), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", validate.mime_type(given).alias("mime"), validate.mime_type(F.col("text")).alias("of_text"))


# Merging and escalation


@query("""
WITH c AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) * 2 AS conf, CAST(round(l_extendedprice * 100) AS BIGINT) AS minor, l_suppkey AS spot, l_shipmode AS v FROM (SELECT *, 'v' || (l_partkey % 7) AS l_shipmode FROM lineitem)),
amounts AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf DESC, minor, spot) AS n FROM c),
vendors AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf DESC, v, spot) AS n FROM c)
SELECT a.l_orderkey, a.minor AS amount_minor, a.conf AS amount_confidence, CAST(a.spot AS INTEGER) AS amount_at, v.v AS vendor, v.conf AS vendor_confidence
FROM amounts a JOIN vendors v ON a.l_orderkey = v.l_orderkey AND a.n = 1 AND v.n = 1""")
def merge_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct(F.struct(F.lit(0).alias("kind"), F.lit(None).cast("int").alias("doc")).alias("source"), F.col("l_suppkey").cast("int").alias("start"), F.col("l_suppkey").cast("int").alias("end"))
    of = lambda value: F.struct(value.alias("value"), (F.col("l_quantity").cast("int") * 2).alias("confidence"), at.alias("span"))
    money = F.struct(rendered.cents(F.col("l_extendedprice")).alias("minor_units"), F.lit("EUR").alias("currency"))
    vendor = F.concat(F.lit("v"), (F.col("l_partkey") % 7).cast("string"))
    merged = merge_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", extraction(amount=of(money), vendor=of(vendor)).alias("extraction")), ["l_orderkey"])
    x = F.col("extraction")
    return merged.select("l_orderkey", x["amount"]["value"]["minor_units"].alias("amount_minor"), x["amount"]["confidence"].alias("amount_confidence"), x["amount"]["span"]["start"].alias("amount_at"), x["vendor"]["value"].alias("vendor"), x["vendor"]["confidence"].alias("vendor_confidence"))


@query("SELECT l_orderkey, string_agg(DISTINCT note, ',' ORDER BY note) AS notes FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'NoTextLayer' WHEN l_returnflag = 'A' THEN 'UnreadableArchive' END AS note FROM lineitem) GROUP BY l_orderkey HAVING count(note) > 0")
def merge_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "NoTextLayer").when(F.col("l_returnflag") == "A", "UnreadableArchive")
    notes = F.when(kind.isNotNull(), F.array(F.struct(kind.alias("kind"), F.lit(0).alias("document")))).otherwise(F.array().cast("array<struct<kind:string,document:int>>"))
    merged = merge_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", extraction(notes).alias("extraction")), ["l_orderkey"])
    return merged.where(F.size("extraction.notes") > 0).select("l_orderkey", F.array_join(F.transform("extraction.notes", lambda n: n["kind"]), ",").alias("notes"))


@query(f"WITH {FACTS} SELECT o_orderkey, kind IN (0, 1, 2, 3, 6) AS complete FROM told")
def is_complete_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_extractor(_envelopes(spark, sf_dir), "x").select("o_orderkey", is_complete(F.col("x")).alias("complete"))


@query(f"WITH {FACTS} SELECT o_orderkey, CASE WHEN kind IN (4, 5) THEN 7 WHEN kind = 7 THEN amount_minor ELSE amount_minor END AS amount_minor, CASE WHEN kind IN (4, 5, 7) THEN 'second' ELSE vendor END AS vendor, kind IN (4, 5, 7) AS asked FROM told")
def escalate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass that finds 7 hundredths of EUR at 70 and a vendor, for incomplete rows only."""

    def second(df: DataFrame, out: str) -> DataFrame:
        at = F.struct(F.struct(F.lit(3).alias("kind"), F.lit(None).cast("int").alias("doc")).alias("source"), F.lit(0).alias("start"), F.lit(0).alias("end"))
        of = lambda v: F.struct(v.alias("value"), F.lit(70).alias("confidence"), at.alias("span"))
        asked = F.array(F.struct(F.lit("asked").alias("kind"), F.lit(None).cast("int").alias("document")))
        return df.withColumn(out, extraction(asked, amount=of(F.struct(F.lit(7).cast("bigint").alias("minor_units"), F.lit("EUR").alias("currency"))), vendor=of(F.lit("second"))))

    done = escalate(text_extractor, second)(_envelopes(spark, sf_dir), "x")
    return done.select("o_orderkey", F.col("x.amount.value.minor_units").alias("amount_minor"), F.col("x.vendor.value").alias("vendor"), (F.size("x.notes") > 0).alias("asked"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(least(CAST(l_quantity AS INTEGER) * 3, 70, 100) AS INTEGER) AS capped, CASE WHEN l_quantity * 3 BETWEEN 0 AND 100 THEN CAST(l_quantity AS INTEGER) * 3 END AS valid FROM lineitem")
def confidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("l_quantity").cast("int") * 3
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", validate.clamped(F.least(c, F.lit(70))).alias("capped"), validate.confidence(c).alias("valid"))


# The bill table


@query("SELECT doc_id, sha256(text) AS id FROM documents")
def raw_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(text.raw_hash(F.col("text").cast("binary")))).alias("id"))


def _as_messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as messages, and the hashes of those from src0 as stored already."""
    given = table(spark, sf_dir, "documents").select("doc_id", "source", text.raw_hash(F.col("text").cast("binary")).alias("hash"))
    return given, given.where("source = 'src0'").select("hash").distinct()


_OUTCOMES = """
WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents),
known AS (SELECT DISTINCT h FROM d WHERE source = 'src0'),
o AS (SELECT doc_id, CASE WHEN h IN (SELECT h FROM known) OR row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'created' END AS outcome FROM d)"""


@query(_OUTCOMES + "SELECT doc_id, outcome FROM o")
def ingest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, stored = _as_messages(spark, sf_dir)
    return bills.outcomes(given, stored, F.col("doc_id")).select("doc_id", "outcome")


@query("SELECT sha256(text) AS id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, _ = _as_messages(spark, sf_dir)
    return bills.first_of_each_hash(given, F.col("doc_id")).where("first").select(F.lower(F.hex("hash")).alias("id"), "doc_id")


@query(_OUTCOMES + "SELECT count(*) AS total, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'duplicate') AS duplicate, CAST(0 AS BIGINT) AS failed FROM o")
def poll_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, stored = _as_messages(spark, sf_dir)
    return bills.report(bills.outcomes(given, stored, F.col("doc_id")))


@query(_OUTCOMES + "SELECT doc_id, upper(outcome[1]) || outcome[2:] || ' ' || doc_id AS line FROM o")
def outcome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, stored = _as_messages(spark, sf_dir)
    done = bills.outcomes(given, stored, F.col("doc_id")).select("doc_id", F.col("doc_id").cast("string").alias("id"), "outcome", F.lit(None).cast("string").alias("error"))
    return done.select("doc_id", F.col("id"), "outcome", "error").transform(lambda d: bills.lines(d).select(F.regexp_extract("line", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "line"))


@query(f"WITH {BILLS}, h AS (SELECT * FROM held WHERE seq % 2 = 0) SELECT seq - 1 AS o_orderkey, (SELECT max(seq) FROM h) + row_number() OVER (ORDER BY seq) AS new_seq FROM held WHERE seq % 2 = 1")
def insert_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even bills are stored; the odd ones get the numbers after the last."""
    all_ = _bills(spark, sf_dir)
    new = all_.where("seq % 2 = 1 OR seq % 4 = 0").select(F.col("seq").alias("nth"), *[c for c in all_.columns if c not in ("seq", "inserted_at")])
    return bills.insert(all_.where("seq % 2 = 0"), new, ["nth"]).select((F.col("nth") - 1).alias("o_orderkey"), F.col("seq").alias("new_seq"))


_COLUMNS = ", ".join(SHOWN)


@query(f"WITH {BILLS} SELECT {_COLUMNS} FROM held WHERE id = sha256('77')")
def get_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.get(_stored(spark, sf_dir).read(), "a88a7902cb4ef697ba0b6759c50e8c10297ff58f942243de19b984841bfe1f73").select(*SHOWN)


@query(f"WITH {BILLS} SELECT {_COLUMNS} FROM held WHERE id = sha256('78')")
def find_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.find_by_hash(_stored(spark, sf_dir).read(), "349c41201b62db851192665c504b350ff98c6b45fb62a8a2161f78b6534d8de9").select(*SHOWN)


@query(f"WITH {BILLS} SELECT {_COLUMNS} FROM held WHERE id IN (SELECT sha256(CAST(c_custkey AS VARCHAR)) FROM customer)")
def probe_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored bills among many hashes at once: those of the customers' numbers."""
    keys = table(spark, sf_dir, "customer").select(text.raw_hash(F.col("c_custkey").cast("string").cast("binary")).alias("hash"))
    return bills.checked(among(_stored(spark, sf_dir).read(), "hash", keys)).select(*SHOWN)


@query(f"WITH {BILLS} SELECT {_COLUMNS} FROM held")
def list_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.listed(_bills(spark, sf_dir)).select(*SHOWN)


@query(f"WITH {BILLS} SELECT {_COLUMNS} FROM held WHERE status = 'needs_review'")
def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.newest_first(_bills(spark, sf_dir), needs_review_only=True).select(*SHOWN)


@query(f"WITH {BILLS} SELECT {_COLUMNS} FROM held ORDER BY seq DESC LIMIT 50")
def list_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.kept_and_next(bills.page(_bills(spark, sf_dir), 50), 50)[0].select(*SHOWN)


@query(f"WITH {BILLS} SELECT {_COLUMNS} FROM held WHERE seq < 501 ORDER BY seq DESC LIMIT 20")
def list_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.kept_and_next(bills.page(_bills(spark, sf_dir), 20, before="0604cd3138feed202ef293e062da2f4720f77a05d25ee036a7a01c9cfcdd1f0a"), 20)[0].select(*SHOWN)


@query(f"WITH {BILLS} SELECT {_COLUMNS} FROM held WHERE status = 'needs_review' ORDER BY seq DESC LIMIT 200")
def list_page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.kept_and_next(bills.page(_bills(spark, sf_dir), 200, status="needs_review"), 200)[0].select(*SHOWN)


@query(f"WITH {BILLS}, p AS (SELECT id, seq FROM held ORDER BY seq DESC LIMIT 50) SELECT CASE WHEN (SELECT count(*) FROM held) > 50 THEN (SELECT id FROM p ORDER BY seq LIMIT 1) END AS next")
def next_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.kept_and_next(bills.page(_bills(spark, sf_dir), 50), 50)[1]


def _changed(stored: DataFrame) -> DataFrame:
    """Every fifth bill loses its due date and its amount, and needs review."""
    hit = F.col("seq") % 5 == 0
    none = {"due": "date", "amount_minor": "bigint", "currency": "string"}
    return stored.withColumns({c: F.when(~hit, F.col(c)).cast(t) for c, t in none.items()} | {"status": F.when(hit, "needs_review").otherwise(F.col("status"))})


@query(f"""WITH {BILLS} SELECT seq, id, vendor, CASE WHEN seq % 5 <> 0 THEN amount_minor END AS amount_minor, CASE WHEN seq % 5 <> 0 THEN currency END AS currency, issued, CASE WHEN seq % 5 <> 0 THEN due END AS due,
CASE WHEN seq % 5 = 0 THEN 'needs_review' ELSE status END AS status FROM held""")
def replace_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    stored.replace(_changed(stored.read()).where("seq % 5 = 0"))
    return stored.read().select(*SHOWN)


@query(f"""WITH {BILLS} SELECT seq, CASE WHEN seq % 9 = 0 THEN 'created' WHEN seq % 5 = 0 AND (due IS NOT NULL OR amount_minor IS NOT NULL OR status <> 'needs_review') THEN 'updated' ELSE 'unchanged' END AS outcome FROM held""")
def reextract_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _bills(spark, sf_dir)
    return bills.compared(_changed(stored), stored.where("seq % 9 <> 0")).select("seq", "outcome")


@query(f"""WITH {BILLS} SELECT seq, CASE WHEN seq % 10 = 0 THEN 'unknown status' WHEN seq % 10 = 1 AND amount_minor IS NOT NULL THEN 'unknown currency' END AS reason FROM held WHERE seq % 10 = 0 OR seq % 10 = 1 AND amount_minor IS NOT NULL""")
def corrupt_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _bills(spark, sf_dir)
    broken = stored.withColumns({"status": F.when(F.col("seq") % 10 == 0, "paid").otherwise(F.col("status")), "currency": F.when(F.col("seq") % 10 == 1, "HRK").otherwise(F.col("currency"))})
    return bills.split_corrupt(broken)[1].select("seq", F.col("_corrupt_reason").alias("reason"))


# Windows of a mailbox


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'")
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, before = validate.date_range("2024-01-02", "2024-01-05")
    return table(spark, sf_dir, "events").where(text.in_window(F.col("ts"), after, before)).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03'")
def poll_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = text.poll_start(datetime.datetime(2024, 1, 4, 13, 5, tzinfo=datetime.UTC))
    return table(spark, sf_dir, "events").where(text.in_window(F.col("ts"), start, None)).select("event_id")


# Decoding


@query(f"WITH {FACTS} SELECT o_orderkey, 'Bill ' || o_orderkey AS subject, 'Billing@Cust' || o_custkey || '.Example.COM' AS sender, CASE WHEN kind % 2 = 0 THEN c_name END AS sender_name, issued_on AS sent, kind = 7 AS is_html, 'application/octet-stream' AS mime, 'key.bin' AS filename, CAST(o_orderkey AS VARCHAR) AS attached FROM facts")
def mime_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendered.messages(rendered.bodies(rendered.orders(spark, sf_dir))).select(F.col("o_orderkey").cast("string").alias("id"), F.lit(b"").alias("hash"), "content")
    d = F.col("documents")[0]
    return mime.decode(rows).select(F.col("id").cast("bigint").alias("o_orderkey"), "subject", "sender", "sender_name", F.col("date").cast("date").alias("sent"), F.col("html").isNotNull().alias("is_html"), d["mime"].alias("mime"), d["filename"].alias("filename"), d["bytes"].cast("string").alias("attached"))


def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendered.invoices(rendered.orders(spark, sf_dir))
    return rows.withColumn("zip", rendered.zipped(F.col("xml"), F.col("kind") % 2 == 1))


@query(f"WITH {FACTS} SELECT o_orderkey, name, true AS sound FROM facts, (VALUES ('folder/note.txt'), ('folder/bill.XML')) n(name)")
def zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive.unzipped(_archived(spark, sf_dir).select("o_orderkey", "xml", "zip"), "zip")
    sound = F.when(F.col("name") == "folder/note.txt", F.col("bytes").cast("string") == "note").otherwise(F.col("bytes").cast("string") == F.col("xml"))
    return read.select("o_orderkey", "name", sound.alias("sound"))


@query(f"""WITH {FACTS} SELECT o_orderkey, minor AS amount_minor, 'COP' AS currency, CASE WHEN kind % 3 = 0 THEN c_name || ' & Co' ELSE c_name END AS vendor, issued_on AS issued, due_on AS due,
CASE WHEN kind % 2 = 0 THEN issued_on END AS period_start, CASE WHEN kind % 2 = 0 THEN due_on END AS period_end, 100 AS confidence FROM facts""")
def ubl_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(F.lit("application/octet-stream").alias("mime"), F.lit("Bill.ZIP").alias("filename"), F.col("zip").alias("bytes"))
    mails = _archived(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("id"), F.array(doc).alias("documents"))
    x = F.col("x")
    return xml_extractor(mails, "x").select(
        F.col("id").cast("bigint").alias("o_orderkey"), x["amount"]["value"]["minor_units"].alias("amount_minor"), x["amount"]["value"]["currency"].alias("currency"), x["vendor"]["value"].alias("vendor"), x["issued"]["value"].alias("issued"),
        x["due"]["value"].alias("due"), x["period"]["value"]["start"].alias("period_start"), x["period"]["value"]["end"].alias("period_end"), x["vendor"]["confidence"].alias("confidence"),
    )


@query("""
WITH k AS (SELECT o_orderkey, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, k = 0 OR k = 1 AS is_zip FROM k""")
def is_zip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "application/x-zip-compressed").when(k == 3, "application/pdf").otherwise("application/octet-stream")
    name = F.when(k == 2, F.lit(None).cast("string")).otherwise("A.Zip")
    return table(spark, sf_dir, "orders").select("o_orderkey", is_zip(kind, name).alias("is_zip"))


@query(f"""WITH {FACTS} SELECT o_orderkey, CASE WHEN kind <> 2 THEN minor END AS amount_minor, CASE WHEN kind NOT IN (1, 2) THEN c_name END AS vendor, CASE WHEN kind NOT IN (2, 3) THEN issued_on END AS issued, CASE WHEN kind <> 2 THEN CAST(least(minor % 100, 70) AS INTEGER) END AS confidence, kind = 2 AS malformed FROM facts""")
def llm_map_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rendered.orders(spark, sf_dir)
    kind = F.col("kind")
    body = F.to_json(F.struct(F.when(kind == 1, "  ").otherwise(F.col("c_name")).alias("vendor"), F.col("minor").alias("amount_minor_units"), F.lit("EUR").alias("currency"), F.when(kind == 3, "soon").otherwise(F.col("issued").cast("string")).alias("issued"), F.when(kind != 2, F.col("minor") % 100).alias("confidence")))
    reply = F.when(kind % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).otherwise(body)
    x = F.col("x")
    return o.withColumn("x", model_pass.map_reply(reply)).select("o_orderkey", x["amount"]["value"]["minor_units"].alias("amount_minor"), x["vendor"]["value"].alias("vendor"), x["issued"]["value"].alias("issued"), x["amount"]["confidence"].alias("confidence"), (F.size(x["notes"]) > 0).alias("malformed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '{\"a\":' || o_orderkey || '}' || chr(10) || 'x' ELSE '{\"a\":' || o_orderkey || '}' END AS inner_text FROM orders")
def strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, body = F.col("o_orderkey") % 4, F.concat(F.lit('{"a":'), F.col("o_orderkey").cast("string"), F.lit("}"))
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit(" ```json\r\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("```\n"), body, F.lit("\n ```  "))).otherwise(F.concat(F.lit("```"), body, F.lit("\nx")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.strip_fence(reply).alias("inner_text"))


@query("SELECT doc_id, substring(coalesce(text, ''), 1, 20000) AS body FROM documents")
def body_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the model's window: the first 20,000 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", model_pass.body_text(F.col("text"), F.lit(None).cast("string")).alias("body"))


# Formats and encodings


@query("SELECT o_orderkey, '[' || year(o_orderdate) || ',' || dayofyear(o_orderdate) || ']' AS pair, CAST(o_orderdate AS DATE) AS back FROM orders")
def json_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = text.json_date(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(pair).alias("pair"), text.unjson_date(pair).alias("back"))


@query(f"""WITH {BILLS} SELECT seq, '{{"id":"' || id || '","vendor":"' || vendor || '","amount":' || coalesce('{{"minor_units":' || amount_minor || ',"currency":"EUR"}}', 'null') || ',"period":null,"issued":[' || year(issued) || ',' || dayofyear(issued) || '],"due":'
|| coalesce('[' || year(due) || ',' || dayofyear(due) || ']', 'null') || ',"status":"' || status || '"}}' AS json FROM held""")
def bill_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("id", "vendor", "amount_minor", "currency", "period_start", "period_end", "issued", "due", "status")
    return _bills(spark, sf_dir).select("seq", text.bill_json(*[F.col(c) for c in columns]).alias("json"))


@query(f"WITH {BILLS} SELECT seq, seq % 5 < 4 AS sound, CASE WHEN seq % 5 < 4 THEN id END AS id, CASE WHEN seq % 5 < 4 THEN vendor END AS vendor, CASE WHEN seq % 5 < 4 THEN amount_minor END AS amount_minor, CASE WHEN seq % 5 < 4 THEN currency END AS currency, CASE WHEN seq % 5 < 4 THEN issued END AS issued, CASE WHEN seq % 5 < 4 THEN due END AS due, CASE WHEN seq % 5 < 4 THEN status END AS status FROM held")
def bill_json_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("id", "vendor", "amount_minor", "currency", "period_start", "period_end", "issued", "due", "status")
    # every fifth one is broken, in one of four ways
    broken = {0: ('"vendor":"', '"vendor":" \t","was":"'), 1: ('"status":"', '"status":"un'), 2: ('"id":"', '"id":"é'), 3: ('"due":', '"due":[2023,366],"was":')}
    json, way = text.bill_json(*[F.col(c) for c in columns]), F.floor(F.col("seq") / 5) % 4
    spoilt = json
    for n, (old, new) in broken.items():
        spoilt = F.when(way == n, F.replace(json, F.lit(old), F.lit(new))).otherwise(spoilt)
    back = _bills(spark, sf_dir).select("seq", text.unbill_json(F.when(F.col("seq") % 5 == 4, spoilt).otherwise(json)).alias("j"))
    return back.select("seq", F.col("j").isNotNull().alias("sound"), "j.id", "j.vendor", "j.amount_minor", "j.currency", "j.issued", "j.due", "j.status")


@query("""
WITH m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) // (CASE WHEN l_linenumber = 1 THEN 100000 ELSE 1 END) END AS minor FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce((CASE WHEN minor < 0 THEN '-' ELSE '' END) || (abs(minor) // 100) || '.' || printf('%02d', abs(minor) % 100) || ' EUR', '-') AS shown FROM m""")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    minor = F.when(n % 3 != 0, F.when(n == 1, F.expr("cast(round(l_extendedprice * 100) as bigint) div 100000")).otherwise(rendered.cents(F.col("l_extendedprice")) * F.when(n % 2 == 0, -1).otherwise(1)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.money_format(minor, F.lit("EUR")).alias("shown"))


@query(f"WITH {BILLS} SELECT seq, substr(id, 1, 8) AS id, vendor, coalesce(CAST(due AS VARCHAR), '-') AS due, '-' AS period, status FROM held")
def row_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bills(spark, sf_dir).select("seq", text.id_prefix(F.col("id")).alias("id"), text.or_dash(F.col("vendor")).alias("vendor"), text.or_dash(F.col("due")).alias("due"), text.period_format(F.col("period_start"), F.col("period_end")).alias("period"), "status")


@query("SELECT doc_id, replace(replace(to_base64(encode(text)), '+', '-'), '/', '_') AS encoded, true AS back FROM documents")
def base64url(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("text").cast("binary")
    encoded = text.base64url(content)
    return table(spark, sf_dir, "documents").select("doc_id", encoded.alias("encoded"), ((text.unbase64url(encoded) == content) & (text.unbase64url(text.base64url(content, padded=False)) == content)).alias("back"))


@query("SELECT doc_id, rtrim(replace(replace(to_base64(unhex(sha256(text))), '+', '-'), '/', '_'), '=') AS challenge FROM documents")
def pkce_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.pkce_challenge(F.col("text").cast("binary")).alias("challenge"))


@query("SELECT doc_id, url_encode(text) AS encoded FROM documents")
def percent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.percent_encode(F.col("text")).alias("encoded"))


@query("""
WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
coded AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
bytes AS (SELECT doc_id, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM coded)
SELECT doc_id, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(t[CAST((xor(c, x) & 255) + 1 AS BIGINT)], c >> 8))) AS crc FROM bytes, steps""")
def crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))
