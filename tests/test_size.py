"""What keeps the work of a row small and its tasks short, held against the plainer ways."""

import email
import random
import zipfile

from pyspark.sql import functions as F

from tallyforge.functions.scan import AMOUNT, AMOUNT_GROUPS, pieces, scan
from tallyforge.plans import rendered
from tallyforge.sources import archive, mime

SF = "/root/testdata/sf0.001"


def test_tasks_are_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(rendered, "ROWS", 100)
    assert rendered.orders(spark, SF).rdd.getNumPartitions() == 15 and rendered.orders(spark, SF).count() == 1500


def test_numerals_without_a_marker_are_no_matches(spark):
    text = "1.2 on 02.03.2026, 5 EUR, 7 8 9, $ 4 and 12.5USD or 3 4£"
    found = spark.createDataFrame([(text,)], "t string").select(pieces(F.col("t"), AMOUNT, AMOUNT_GROUPS).alias("p")).first().p
    assert [p[2] for p in found[1:]] == ["5", "12.5", "3 4"]


def test_fields_that_nobody_takes_are_not_looked_for(spark):
    found = scan(spark.createDataFrame([("5 EUR",)], "t string"), "t", "f", 0)
    plan = found.select("f.issued")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?=[0-9])(?<![0-9])" not in plan and "(?=[0-9])(?<![0-9])" in found.select("f.amount")._jdf.queryExecution().optimizedPlan().toString()


def shape(message):
    parts = message._payload
    return list(message.raw_items()), message.get_content_type(), [shape(p) for p in parts] if isinstance(parts, list) else parts


def test_messages_cut_at_delimiters_are_as_the_parser_has_them():
    rng = random.Random(5)
    given = [b"From: a@b.c", b" folded", b"\tf", b":", b"From x", b"\r\n", b"\n", b"\r\n\r\n", b"\n\n", b"--part", b"--part--", b"--part \r\n", b"\r\n--part\r\n", b"\r\n--part--\r\n", b"Content-Type: text/plain", b'Content-Type: multipart/mixed; boundary="part"',
             b"Content-Type: multipart/digest; boundary=part", b"Content-Type: message/rfc822", b"body", b"\r", b"\xc3\xa9", b" ", b"-", b"\x0c", b"\x85"]
    starts = [b'From: a@b.c\r\nContent-Type: multipart/mixed; boundary="part"\r\n', b'From: a@b.c\r\nContent-Type: multipart/mixed; boundary="part"\r\n\r\n--part\r\nContent-Type: text/plain\r\n\r\n', b"From: a@b.c\r\n"]
    flat = multipart = 0
    for _ in range(20_000):
        raw = rng.choice(starts) + b"".join(rng.choice(given) for _ in range(rng.randint(0, 10))) + rng.choice([b"", b"\r\n--part--\r\n"])
        cut = mime._flat(raw.decode("ascii", "surrogateescape"))
        if cut is not None:
            flat += 1
            multipart += cut.is_multipart()
            assert shape(cut) == shape(email.message_from_bytes(raw)), raw
    assert flat > 1000 and multipart > 100


def test_archives_made_from_parts_are_whole_archives():
    for text in ("", "x", "é<a>" * 500):
        for plain, method in ((True, zipfile.ZIP_STORED), (False, zipfile.ZIP_DEFLATED)):
            made = rendered.archives(plain)(text)
            assert made == rendered.archive(text.encode(), method)
            assert archive.entries(made) == [("folder/note.txt", b"note"), ("folder/bill.XML", text.encode())]


def test_unzipping_in_batches_equals_the_table_function(spark, monkeypatch):
    monkeypatch.setattr(archive, "CHUNK", 10)
    whole = rendered.archives(False)("a text that is long enough")
    rng, given = random.Random(1), [None, b"", b"PK", whole, rendered.archives(True)("b")]
    for _ in range(200):
        at = rng.randrange(len(whole))
        given.append(whole[:at] + bytes([rng.randrange(256)]) + whole[at + 1 :])
    rows = spark.createDataFrame(list(enumerate(given)), "i int, zip binary")
    archive.register(spark)
    rows.createOrReplaceTempView("given_zips")
    of = lambda df: sorted(map(repr, df.collect()))
    assert of(archive.unzipped(rows, "zip").select("i", "name", "bytes", "error")) == of(spark.sql("SELECT i, name, bytes, error FROM given_zips, LATERAL unzip(zip)"))


def test_entries_read_directly_are_as_the_standard_reader_has_them(monkeypatch):
    rng, whole = random.Random(2), [rendered.archives(plain)("a text that is long enough") for plain in (True, False)]

    def outcome(data):
        try:
            return archive.entries(data)
        except (archive.Malformed, archive.Unsupported) as e:
            return type(e).__name__

    given = []
    for n in range(4000):
        z = whole[n % 2]
        at = rng.randrange(len(z))
        given.append(z[:at] + bytes([rng.randrange(256)]) + z[at + 1 :])
    direct = [outcome(z) for z in [*whole, *given]]
    monkeypatch.setattr(archive, "_plain", lambda *_: None)
    assert direct == [outcome(z) for z in [*whole, *given]]
