import datetime
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import validate as V
from tallyforge.operators import bills, model_pass
from tallyforge.operators.extract import bill_rows, chain, escalate, text_extractor
from tallyforge.operators.merge import extraction, merge_columns, merge_rows
from tallyforge.schemas import BILLS, EXTRACTION

D = datetime.date


def field(value, confidence, start=0, kind=0):
    return {"value": value, "confidence": confidence, "span": {"source": {"kind": kind, "doc": None}, "start": start, "end": start + 1}}


spans = st.tuples(st.integers(0, 3), st.integers(0, 5))
fields = lambda values: st.one_of(st.none(), st.builds(lambda v, c, s: field(v, c, s[1], s[0]), values, st.integers(0, 100), spans))
days = st.dates(D(2020, 1, 1), D(2020, 1, 9))
extractions = st.fixed_dictionaries({
    "amount": fields(st.fixed_dictionaries({"minor_units": st.integers(-2, 2), "currency": st.sampled_from(["EUR", "USD"])})), "issued": fields(days), "due": fields(days),
    "period": fields(st.builds(lambda a, n: {"start": a, "end": a + datetime.timedelta(n)}, days, st.integers(0, 3))), "vendor": fields(st.sampled_from(["a", "b"])),
    "notes": st.lists(st.fixed_dictionaries({"kind": st.sampled_from(["x", "y"]), "document": st.integers(0, 1)}), max_size=2),
})


def plain_merge(parts):
    out = {}
    for name in ("amount", "issued", "due", "period", "vendor"):
        found = [p[name] for p in parts if p[name]]
        key = lambda f: (-f["confidence"], tuple(f["value"][k] for k in ("minor_units", "currency", "start", "end") if k in f["value"]) if isinstance(f["value"], dict) else f["value"], f["span"]["source"]["kind"], f["span"]["start"], f["span"]["end"])
        out[name] = min(found, key=key) if found else None
    out["notes"] = sorted({(n["kind"], n["document"]) for p in parts for n in p["notes"]})
    return out


def plain(row):
    d = row.asDict(recursive=True)
    return d | {"notes": [(n["kind"], n["document"]) for n in d["notes"]]}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(extractions, min_size=1, max_size=5), min_size=1, max_size=25))
def test_merge_is_the_plain_minimum_in_any_order(spark, groups):
    rows = [(i, p) for i, parts in enumerate(groups) for p in [*parts, parts[0]]]
    df = spark.createDataFrame(rows, f"i int, extraction {EXTRACTION}")
    for some in (df, df.orderBy(F.desc("i"), F.rand(3))):
        got = {r.i: plain(r.extraction) for r in merge_rows(some, ["i"]).collect()}
        assert got == {i: plain_merge(parts) for i, parts in enumerate(groups)}


def test_merge_in_a_row(spark):
    a, b = {"amount": None, "issued": field(D(2020, 1, 2), 40), "due": None, "period": None, "vendor": field("z", 20), "notes": []}, {"amount": None, "issued": field(D(2020, 1, 1), 40), "due": None, "period": None, "vendor": None, "notes": [{"kind": "n", "document": 1}]}
    df = spark.createDataFrame([(a, b, None)], f"a {EXTRACTION}, b {EXTRACTION}, c {EXTRACTION}")
    got = plain(df.select(merge_columns([F.col("a"), F.col("b"), F.col("c")]).alias("m")).first().m)
    assert got == plain_merge([a, b])


def envelopes(spark, *rows):
    return spark.createDataFrame([(str(i), bytearray([i]), *r, []) for i, r in enumerate(rows)], "id string, hash binary, sender string, sender_name string, text string, html string, documents array<struct<mime string, filename string, bytes binary>>")


def test_vendor(spark):
    df = envelopes(spark, ("a@B.com", " Name ", None, None), ("a@b@C.d", "　", None, None), ("nobody", None, None, None), ("a@", None, None, None))
    got = [r.x.vendor and r.x.vendor.value for r in text_extractor(df, "x").orderBy("id").collect()]
    assert got == ["Name", "b@c.d", None, None]


def test_status_follows_completeness(spark):
    df = envelopes(spark, ("a@b.c", None, "total 5 EUR, date 2026-01-02", None), ("a@b.c", None, "5 EUR\n2026-01-02", None), ("a@b.c", None, "total 5 EUR", None), ("a", None, "total 5 EUR date 2026-01-02", None))
    rows = {r.id: r for r in bill_rows(text_extractor(df, "extraction")).collect()}
    assert [rows[str(i)].status for i in range(4)] == ["extracted", "needs_review", "needs_review", "needs_review"]
    assert rows["1"].amount_minor == 500 and rows["2"].currency == "EUR"


def test_escalation_asks_for_incomplete_rows_only(spark):
    asked = spark.sparkContext.accumulator(0)

    def second(df, out):
        def run(batches):
            for b in batches:
                asked.add(len(b))
                yield b

        return df.select("id").mapInPandas(run, "id string").join(df, "id").withColumn(out, extraction())

    df = envelopes(spark, *[("a@b.c", None, "total 5 EUR, date 2026-01-02", None)] * 9, ("a@b.c", None, "hello", None))
    assert escalate(text_extractor, second)(df, "x").count() == 10
    assert asked.value == 1
    escalate(text_extractor, second, least=101)(df, "x").count()
    assert asked.value == 11


def test_chain_keeps_the_first_error_and_merges(spark):
    def failing(word):
        return lambda df, out: df.withColumn(out, extraction()).withColumn("error", F.lit(word))

    df = envelopes(spark, ("a@b.c", None, "total 5 EUR", None))
    got = chain([text_extractor, failing("one"), failing("two")])(df, "x").first()
    assert got.error == "one" and got.x.amount.value.minor_units == 500
    assert chain([])(df, "x").first().x.amount is None


def stored(spark, n=30):
    return spark.createDataFrame([(i, f"id{i}", bytearray([i]), "v", 100, "EUR", None, None, D(2020, 1, 1), None, "needs_review" if i % 3 == 0 else "extracted", None) for i in range(1, n + 1)], BILLS)


@pytest.mark.parametrize(("size", "status"), [(4, None), (7, "needs_review"), (200, None)])
def test_pages_follow_the_reversed_list(spark, size, status):
    table, got, before = stored(spark).cache(), [], None
    while True:
        kept, following = bills.kept_and_next(bills.page(table, size, status, before), size)
        got += [r.id for r in kept.orderBy(F.desc("seq")).collect()]
        before = following.first().next
        if before is None:
            break
    assert got == [f"id{i}" for i in range(30, 0, -1) if status is None or i % 3 == 0]


def test_page_errors(spark):
    with pytest.raises(LookupError):
        bills.page(stored(spark), 5, before="nothing")
    for n in (0, 201):
        with pytest.raises(ValueError):
            bills.page(stored(spark), n)


def new_rows(spark, *rows):
    return spark.createDataFrame([(i, f"new{i}", bytearray(h), "v", 1, "EUR", None, None, None, None, "needs_review") for i, h in rows], "nth int, id string, hash binary, vendor string, amount_minor bigint, currency string, period_start date, period_end date, issued date, due date, status string")


def test_insert_is_idempotent_and_numbers_follow(spark):
    fresh = bills.insert(stored(spark), new_rows(spark, (1, b"x"), (2, b"y"), (3, b"\x05"), (4, b"z")), ["nth"]).collect()
    assert sorted((r.nth, r.seq) for r in fresh) == [(1, 31), (2, 32), (4, 33)]
    clash = new_rows(spark, (1, b"x")).withColumn("id", F.lit("id3"))
    with pytest.raises(ValueError):
        bills.insert(stored(spark), clash, ["nth"])
    assert bills.insert(stored(spark).where("false"), new_rows(spark, (1, b"x")), ["nth"]).first().seq == 1


def test_replace_keeps_identity_and_sets_nulls(spark):
    table = stored(spark)
    update = table.where("seq = 4").withColumns({"vendor": F.lit(None).cast("string"), "status": F.lit("needs_review"), "seq": F.lit(99).cast("bigint")})
    got = bills.replaced(table, update).where("id = 'id4'").first()
    assert (got.seq, got.vendor, got.status) == (4, None, "needs_review")
    with pytest.raises(LookupError):
        bills.replaced(table, update.withColumn("id", F.lit("other")))


def test_corrupt_rows(spark):
    table = stored(spark)
    broken = table.withColumn("status", F.when(F.col("seq") == 5, "paid").otherwise(F.col("status")))
    with pytest.raises(Exception, match="corrupt bill id5"):
        bills.listed(broken).collect()
    sound, corrupt = bills.split_corrupt(broken)
    assert sound.count() == 29 and corrupt.first()._corrupt_reason == "unknown status"
    half = table.where("seq = 3").withColumn("currency", F.lit(None).cast("string"))
    assert bills.listed(half).first().amount_minor is None


def test_reply_mapping(spark):
    ok = {"vendor": " v ", "amount_minor_units": -5, "currency": "EUR", "period_start": "2020-01-02", "period_end": "2020-01-01", "issued": "2020-02-30", "due": "2020-02-28", "confidence": 90}
    replies = [json.dumps(ok), "```json\n" + json.dumps(ok | {"confidence": 200}) + "\n```", json.dumps(ok | {"confidence": None}), json.dumps(ok | {"vendor": 3}), "{", "[]", json.dumps({"confidence": 5})]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = [r.x for r in df.withColumn("x", model_pass.map_reply(F.col("reply"))).orderBy("i").collect()]
    assert got[0].vendor.value == "v" and got[0].amount.value.minor_units == -5 and got[0].period is None and got[0].issued is None and got[0].due.confidence == 70
    assert got[1].vendor.confidence == 70 and got[6].notes == [] and got[6].vendor is None
    assert all([n.kind for n in g.notes] == ["LlmMalformed"] and g.vendor is None for g in got[2:6])


class Canned:
    def complete(self, instructions, parts, keys):
        if "down" in parts[0]:
            raise model_pass.Unreachable
        return json.dumps({"vendor": "v", "confidence": 60})


def test_model_pass(spark):
    df = envelopes(spark, ("a@b.c", None, "hello", None), ("a@b.c", None, "down", None), ("a@b.c", None, None, None), ("a@b.c", None, None, "<p>x</p>"))
    got = {r.id: r for r in model_pass.model_extractor(Canned())(df, "x").collect()}
    assert got["0"].x.vendor.value == "v" and got["3"].x.vendor.value == "v"
    assert [n.kind for n in got["1"].x.notes] == ["LlmUnavailable"] and got["2"].x.vendor is None and got["2"].x.notes == []


def test_types(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert len(V.ISO_4217) == len(set(V.ISO_4217)) == 171
    assert one(V.is_currency(F.lit("eur"))) is False and one(V.is_currency(F.lit("XAU"))) is True
    assert one(V.vendor(F.lit("  a b  "))) == "a b" and one(V.vendor(F.lit(" 　"))) is None
    assert one(V.is_bill_id(F.lit("x" * 128))) and not one(V.is_bill_id(F.lit("x" * 129))) and not one(V.is_bill_id(F.lit("a b"))) and not one(V.is_bill_id(F.lit("a\n")))
    assert one(V.iso_date(F.lit("2024-02-29"))) == D(2024, 2, 29) and one(V.iso_date(F.lit("2023-02-29"))) is None and one(V.iso_date(F.lit("2023-2-2"))) is None
    assert V.date_range("2024-01-01", "2024-01-02") and V.date_range() == (None, None)
    for bad in (("2024-1-1", None), ("2024-01-02", "2024-01-02"), ("20240101", None)):
        with pytest.raises(ValueError):
            V.date_range(*bad)


def test_encodings(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.base64url(F.lit(b"\xfb\xff"))) == "-_8=" and one(T.base64url(F.lit(b"\xfb\xff"), padded=False)) == "-_8"
    assert one(T.unbase64url(F.lit("-_8"))) == b"\xfb\xff" and one(T.unbase64url(F.lit("-_8="))) == b"\xfb\xff" and one(T.unbase64url(F.lit("a"))) is None and one(T.unbase64url(F.lit("+/8="))) is None
    assert one(T.percent_encode(F.lit("a b*~é/"))) == "a%20b%2A~%C3%A9%2F"
    assert one(T.money_format(F.lit(-5).cast("bigint"), F.lit("EUR"))) == "-0.05 EUR" and one(T.money_format(F.lit(123456).cast("bigint"), F.lit("USD"))) == "1234.56 USD" and one(T.money_format(F.lit(None).cast("bigint"), F.lit("USD"))) == "-"
    assert one(F.to_json(T.json_date(F.lit(D(2026, 10, 15))))) == "[2026,288]" and one(T.unjson_date(F.array(F.lit(2023), F.lit(366)))) is None
    assert T.mail_query("bills", D(1970, 1, 2), D(1970, 1, 3)) == "label:bills after:86400 before:172800"
    assert T.poll_start(datetime.datetime(2024, 3, 1, 0, 5, tzinfo=datetime.UTC)) == D(2024, 2, 29)
