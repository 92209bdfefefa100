import datetime
import os
import pathlib
import threading
import time

import pytest
from pyspark.sql import functions as F

from tallyforge import __main__ as shell
from tallyforge.operators import model_pass
from tallyforge.operators.model_pass import Options, Unreachable
from tallyforge.plans.mailbox import fetch
from tallyforge.sources import mail
from tallyforge.sources.config import MissingSetting
from tallyforge.sources.shared import shared_dir
from tallyforge.sources.tables import BillTable
from tallyforge.streaming.poll import Progress, poll_mailbox

DAY = datetime.date(2026, 5, 4)
AT = datetime.datetime(2026, 5, 4, tzinfo=datetime.UTC).timestamp()


def bill(n):
    return b"From: Otter <o@otter.example>\r\n\r\nInvoice date: 2026-05-0%d\r\nTotal: %d.00 EUR\r\n" % (1 + n % 9, n + 10)


def put(folder, name, n, at):
    path = folder / f"{name}.eml"
    path.write_bytes(bill(n))
    os.utime(path, (at, at))


@pytest.fixture
def mails(tmp_path):
    folder = tmp_path / "mails"
    folder.mkdir()
    for d in range(6):
        for i in range(2):
            put(folder, f"d{d}i{i}", 2 * d + i, AT + 86_400 * d + 3600 * i)
    return folder


def test_filters_reach_the_mailbox(spark, mails, monkeypatch):
    mail.register(spark)
    # any message outside of the filters can't be read
    for d in (0, 1, 4, 5):
        for i in range(2):
            (mails / f"d{d}i{i}.eml").chmod(0)
            at = (mails / f"d{d}i{i}.eml").stat().st_mtime
            (mails / f"d{d}i{i}.eml").unlink()
            (mails / f"d{d}i{i}.eml").mkdir()
            os.utime(mails / f"d{d}i{i}.eml", (at, at))
    box = spark.read.format("mailbox").options(folder=str(mails)).load()
    wanted = (F.col("day") > DAY + datetime.timedelta(days=1)) & (F.col("day") <= DAY + datetime.timedelta(days=3)) & (F.col("label") == "bills")
    got = box.where(wanted).collect()
    assert {(r.message_id, str(r.day), r.label) for r in got} == {(f"d{d}i{i}.eml", f"2026-05-0{4 + d}", "bills") for d in (2, 3) for i in range(2)}
    # the same window by options
    options = spark.read.format("mailbox").options(folder=str(mails), after="2026-05-06", before="2026-05-08", label="bills").load()
    assert sorted(map(tuple, options.collect())) == sorted(map(tuple, got))
    with pytest.raises(Exception, match="IsADirectoryError"):
        box.where(F.col("day") == DAY).collect()


def test_pushed_filters_as_windows():
    day = lambda n: DAY + datetime.timedelta(days=n)
    reader = mail.Reader(None, "", None, day(9))
    filters = [mail.GreaterThanOrEqual(("day",), day(2)), mail.LessThan(("day",), day(4)), mail.In(("label",), ("b", "a")), mail.EqualTo(("message_id",), "x")]
    assert list(reader.pushFilters(filters)) == filters
    seconds = [int(AT) + 86_400 * n for n in (2, 3, 4)]
    assert [w.query for w in reader.partitions()] == [f"label:{x} after:{a} before:{b}" for x in "ab" for a, b in zip(seconds, seconds[1:], strict=False)]
    one = mail.Reader(None, "own", day(0), None, today=day(1))
    list(one.pushFilters([mail.EqualTo(("label",), "other"), mail.EqualTo(("day",), None)]))
    assert one.partitions() == []
    ends = mail.Reader(None, "own", day(0), None, today=day(1)).partitions()
    assert [(w.query, w.day) for w in ends] == [(f"label:own after:{int(AT)} before:{int(AT) + 86_400}", day(0)), (f"label:own after:{int(AT) + 86_400}", None)]


def read_stream(spark, folder, out, at, until, **more):
    mail.register(spark)
    stream = spark.readStream.format("mailbox").options(folder=str(folder), after="2026-05-04", until=str(int(until)), label="bills", **more).load()
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_a_stream_goes_on_where_it_stopped(spark, mails, tmp_path):
    out, at = tmp_path / "out", tmp_path / "at"
    read_stream(spark, mails, out, at, AT + 86_400 * 2.5)
    first = sorted(r.message_id for r in spark.read.parquet(str(out)).collect())
    assert first == [f"d{d}i{i}.eml" for d in (0, 1, 2) for i in range(2)]
    # nothing is new
    read_stream(spark, mails, out, at, AT + 86_400 * 2.5)
    read_stream(spark, mails, out, at, AT + 86_400 * 6)
    got = spark.read.parquet(str(out)).collect()
    assert sorted(r.message_id for r in got) == [f"d{d}i{i}.eml" for d in range(6) for i in range(2)]
    assert all(bytes(r.content) == bill(2 * int(r.message_id[1]) + int(r.message_id[3])) and str(r.day) == f"2026-05-0{4 + int(r.message_id[1])}" for r in got)


def test_offsets_and_windows_of_a_stream():
    reader = mail.StreamReader(None, "x", None, True, 0, None, clock=lambda: AT + 100)
    # without a start: from yesterday on
    assert reader.initialOffset() == {"until": int(AT) - 86_400} and reader.latestOffset() == {"until": int(AT) + 40}
    cut = [w.query for w in reader.partitions({"until": int(AT) - 50}, {"until": int(AT) + 86_410})]
    assert cut == [f"label:x after:{int(AT) + a} before:{int(AT) + b}" for a, b in ((-50, 0), (0, 86_400), (86_400, 86_410))]
    assert reader.partitions({"until": 5}, {"until": 5}) == []
    reader.overlap = 60
    assert [w.query for w in reader.partitions({"until": int(AT)}, {"until": int(AT) + 1})] == [f"label:x after:{int(AT) - 60} before:{int(AT)}", f"label:x after:{int(AT)} before:{int(AT) + 1}"]


def test_what_was_taken_is_neither_fetched_nor_looked_for_again(spark, mails, tmp_path, monkeypatch):
    table, log, probed = BillTable(spark, str(tmp_path / "bills")), [], []
    from tallyforge.plans import ingest as plan

    whole = plan.among
    monkeypatch.setattr(plan, "among", lambda bills, column, keys: probed.append(keys.count()) or whole(bills, column, keys))
    scratch = lambda: sorted(pathlib.Path(shared_dir(spark).removeprefix("file:")).glob("scratch/*"))
    shared_dir(spark)
    before, listener = scratch(), Progress(log.append)
    spark.streams.addListener(listener)
    try:
        tick = lambda until: poll_mailbox(spark, table, str(tmp_path / "at"), once=True, log=log.append, outcomes=str(tmp_path / "outcomes"), folder=str(mails), after="2026-05-04", until=str(int(until))).awaitTermination(180)
        tick(AT + 86_400 * 3)
        assert table.read().count() == 6 and "batch 0: 6 total, 6 created, 0 duplicate, 0 failed" in log
        # messages that a batch lists again can't be fetched now; one more has come late
        for d in (1, 2):
            for i in range(2):
                at = (mails / f"d{d}i{i}.eml").stat().st_mtime
                (mails / f"d{d}i{i}.eml").unlink()
                (mails / f"d{d}i{i}.eml").mkdir()
                os.utime(mails / f"d{d}i{i}.eml", (at, at))
        put(mails, "late", 50, AT + 86_400 * 2.9)
        tick(AT + 86_400 * 4)
    finally:
        spark.streams.removeListener(listener)
    assert scratch() == before
    assert table.read().count() == 9 and any("3 total, 3 created, 0 duplicate, 0 failed" in x for x in log)
    assert probed[0] == 6 and sum(probed) == 9
    done = spark.read.parquet(str(tmp_path / "outcomes"))
    assert done.where("outcome = 'created'").count() == 9 and done.select("batch").distinct().count() >= 2
    assert any(x.startswith("progress 0: 6 messages") for x in log)


def test_fetched_by_the_command_line(spark, mails, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(shell, "session", lambda: spark)
    table = str(tmp_path / "bills")
    assert shell.main(["fetch", "--table", table, "--folder", str(mails), "--after", "2026-05-05", "--before", "2026-05-07"]) == 0
    assert capsys.readouterr().out.count("Created") == 4
    assert shell.main(["fetch", "--table", table, "--folder", str(mails)]) == 0
    out = capsys.readouterr().out
    assert out.count("Created") == 8 and out.count("Duplicate") == 4
    assert shell.main(["poll", "--table", table, "--checkpoint", str(tmp_path / "at"), "--folder", str(mails), "--once"]) == 0
    assert shell.main(["tidy", "--table", table]) == 0
    monkeypatch.delenv("MODEL_PROVIDER", raising=False)
    assert shell.main(["fetch", "--table", table, "--folder", str(mails), "--model"]) == 2
    monkeypatch.delenv("MAIL_CLIENT_ID", raising=False)
    with pytest.raises(MissingSetting):
        mail.mailbox_of({})


def test_a_model_by_the_command_line(spark, mails, tmp_path, capsys, monkeypatch):
    class Fixed:
        def complete(self, instructions, parts, keys):
            return '{"vendor": "From the model", "due": "2026-07-01", "confidence": 80}'

    monkeypatch.setattr(shell, "session", lambda: spark)
    monkeypatch.setattr(shell, "ModelClient", lambda settings: Fixed())
    for name, value in (("MODEL_PROVIDER", "ollama"), ("MODEL_NAME", "m")):
        monkeypatch.setenv(name, value)
    (mails / "none.eml").write_bytes(b"From: a@b.c\r\n\r\nnothing here")
    assert shell.main(["fetch", "--table", str(tmp_path / "t"), "--folder", str(mails), "--model"]) == 0
    got = BillTable(spark, str(tmp_path / "t")).read().where("vendor = 'From the model'").collect()
    assert len(got) == 1 and str(got[0].due) == "2026-07-01"


class Slow:
    """Counts how many requests are under way at once; some bodies fail once, or always."""

    def __init__(self):
        self.lock, self.now, self.most, self.asked = threading.Lock(), 0, 0, {}

    def complete(self, instructions, parts, keys):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.asked[parts[0]] = self.asked.get(parts[0], 0) + 1
        time.sleep(0.1)
        with self.lock:
            self.now -= 1
        if "always" in parts[0] or "once" in parts[0] and self.asked[parts[0]] == 1:
            raise Unreachable("busy")
        return f'{{"vendor": "{parts[0]}", "confidence": 9}}'

    def __reduce__(self):
        return (_slow, ())


_one = Slow()


def _slow():
    return _one


def test_requests_run_side_by_side():
    import pyarrow as pa

    client, options = Slow(), Options(pause=0.01)
    given = [f"b{i}" for i in range(30)] + ["fails once", "fails always"]
    kept = {}

    def udf(f, kind):
        kept["f"] = f
        raise StopIteration

    run = model_pass.model_extractor(client, None, options)
    was, model_pass.F.arrow_udf = model_pass.F.arrow_udf, udf
    try:
        with pytest.raises(StopIteration):
            run(_columns(), "x")
    finally:
        model_pass.F.arrow_udf = was
    began = time.monotonic()
    got = kept["f"](pa.array(given), pa.array([[]] * len(given), pa.list_(pa.binary()))).to_pylist()
    assert time.monotonic() - began < 1 and 8 < client.most <= options.at_once
    assert [r["reply"] and r["reply"].split('"')[3] for r in got] == [*given[:-1], None]
    assert [r["note"] for r in got] == [None] * 31 + [model_pass.UNAVAILABLE] and client.asked["fails once"] == 2 and client.asked["fails always"] == 3


def _columns():
    class Frame:
        columns = []

    return Frame()


def test_no_request_is_repeated_beyond_its_time():
    class Down:
        n = 0

        def complete(self, *a):
            self.n += 1
            raise Unreachable("down")

    client = Down()
    with pytest.raises(Unreachable):
        model_pass.asked(client, ["x"], Options(tries=9, pause=0.05, limit=0.2))
    assert client.n == 3


def test_a_window_is_fetched(spark, mails, tmp_path):
    table = BillTable(spark, str(tmp_path / "bills"))
    done = fetch(spark, table, "2026-05-06", None, folder=str(mails))
    assert done.where("outcome = 'created'").count() == 8
