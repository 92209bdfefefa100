import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.scan import minor_units, scan
from tests import model

D = datetime.date
PIECES = ["1", "23", "1,234.56", "1.234,56", "12.5", "007", " ", " ", "\n", " ", ".", ",", "-", "/", "$", "US$", "COP$", "€", "£", "EUR", "USD", "NIT", "THE", "é", "total", "Total:", "total a pagar", "due", "Due date:", "date", "fecha", "fällig", "FÄLLIG", "amount due",
          "2026-10-15", "15.10.2026", "15/10/2026", "31.02.2026", "29/02/2024", "29/02/2023", "3 March 2026", "31 Apr 2026", "Oct 5, 2026", "october 15, 2026", "May 1", "0 Jan 2026", "x", "A", "\u0001", "\u0002", "\u0003", "日", "99999999999999999999"]


def flat(row):
    out = []
    for f in (row.amount, row.due, row.issued):
        if f is None:
            out.append(None)
        else:
            v = f.value
            out.append(((v.minor_units, v.currency) if hasattr(v, "minor_units") else (v,)) + (f.span.start, f.span.end, f.confidence))
    return tuple(out)


def test_scanner_equals_a_plain_model(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    for r in scan(df, "text", "found", 0).select("i", "found.*").collect():
        assert flat(r) == model.scan(texts[r.i]), repr(texts[r.i])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Gesamtbetrag: 1.234,56 €\nRechnungsdatum: 24.09.2026\nfällig 15.10.2026", (123456, "EUR", 90, D(2026, 9, 24), D(2026, 10, 15))),
        ("Total: US$1,234.56, invoice date Sep 24, 2026, due October 15, 2026", (123456, "USD", 90, D(2026, 9, 24), D(2026, 10, 15))),
        ("Montant total 1 234,56 EUR échéance 15/10/2026", (123456, "EUR", 90, None, D(2026, 10, 15))),
        ("5 USD, 500 USD, 20 USD", (50000, "USD", 40, None, None)),
        ("$ 1.234.567", (None, None, None, None, None)),
        ("Vertrag 55/0192 CHF 18 406.5", (18406500, "CHF", 40, None, None)),
        ("COP$ 1.234.567", (123456700, "COP", 40, None, None)),
        ("$ 999.00 and much further on 12.00 EUR", (1200, "EUR", 40, None, None)),
        ("", (None,) * 5),
    ],
)
def test_stated_texts(spark, text, expected):
    r = scan(spark.createDataFrame([(text,)], "text string"), "text", "found", 0).select("found.*").first()
    got = (r.amount and r.amount.value.minor_units, r.amount and r.amount.value.currency, r.amount and r.amount.confidence, r.issued and r.issued.value, r.due and r.due.value)
    assert got == expected


def test_work_grows_with_the_text(spark):
    """0.3 MB with 8,000 amounts, 8,000 dates or 8,000 keywords each take about as long as other text."""
    texts = ["Total: 1,234.56 EUR and more text. " * 8000, "1,234.56 EUR and some more of the text " * 8000, "due 2026-10-15, date 15/10/2026; what else " * 4000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    scan(df.limit(0), "text", "found", 0).collect()
    began = time.time()
    got = scan(df, "text", "found", 0).select("found.*").collect()
    assert time.time() - began < 60
    assert [r.amount and r.amount.confidence for r in got] == [90, 40, None] and got[0].amount.span.start == 7 and got[2].due.span.start == 4 and got[2].issued.span.start == 21


def test_null_text_has_nothing(spark):
    r = scan(spark.createDataFrame([(None,)], "text string"), "text", "found", 0).select("found.*").first()
    assert (r.amount, r.due, r.issued) == (None, None, None)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<td>a</td><td>b", "a b"), ("a<br/>b<BR >c<br x='1'>d", "a b c d"), ("<a title=\"</p>\">x", '">x'), ("x<unclosed", "x"), ("&amp;euro; &euro;&nbsp;&#8364;", "&euro; € €"), ("&copy;&#x41;&#;&", "&copy;&#x41;&#;&"),
        ("&#38;amp;", "&amp;"), ("<script>1 < 2</script>", "1 "), ("a&lt;b&gt;c", "a<b>c"), ("&#128512;", "😀"), ("&#1114112;", "&#1114112;"), ("</ tr >x</H1>y", " x y"), ("<!-- a -->b", "b"), (None, None),
    ],
)
def test_strip_html(spark, html, expected):
    assert spark.createDataFrame([(html,)], "h string").select(T.strip_html(F.col("h"))).first()[0] == expected


def test_stripping_equals_a_plain_model(spark):
    rng = random.Random(3)
    given = ["<", ">", "<b>", "</p>", "<br>", "< BR/ >", "</ Td >", "&", "amp;", "&lt;", "&nbsp;", "&#", "1", "4", "5", "8364", ";", "&#2;", "&#4;", "&#5;", "&#55296;", "\u0001", "\u0002", "\u0003", "\u0004", "\u0005", "\u0006", "\u0007", "\u0008", " ", "x", "é", "\n"]
    texts = ["".join(rng.choice(given) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, h string").repartition(4)
    for r in df.select("i", T.strip_html(F.col("h")).alias("t")).collect():
        assert r.t == model.strip_html(texts[r.i], T.BLOCK_TAGS, T.ENTITIES), repr(texts[r.i])


def test_numerals(spark):
    given = {"1,234.56": 123456, "1.234,56": 123456, "12.5": 12500, "99.50": 9950, "1.234.567": 123456700, "1 234,5": 1234500, "1,2.3": 1230, "1,234.5678": 123456, "2026 1,234.56": 2026123456, "0.05": 5, "007": 700, "92233720368547758.07": 2**63 - 1, "92233720368547758.08": None, "99999999999999999999": None, "1,5 6.7": 15670, "1.5,6 7": None}
    df = spark.createDataFrame([(n,) for n in given], "n string")
    assert {r.n: r.m for r in df.select("n", minor_units(F.col("n")).alias("m")).collect()} == given


def test_keywords_of_several_lists_share_characters(spark):
    """One pass over all lists finds what a pass for each list does."""
    for text in ("amount due 5 EUR on 2026-03-04", "Invoice date due 2026-03-04 2026-05-06", "importe total a pagar 7 EUR", "balance due date: 01/02/2026 total 3 GBP", "Invoice dates 2026-03-04, update 2026-05-06"):
        df = spark.createDataFrame([(text,)], "t string")
        assert flat(scan(df, "t", "f", 0).first().f) == model.scan(text), text
