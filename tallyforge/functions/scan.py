"""Amounts and dates in running text, with byte spans, by built-in expressions only.

One regexp_replace marks all matches of a pattern; byte offsets are running sums over the matches and what is left between them, so that work
grows with the text's length. What surrounds a numeral is captured by groups inside look-arounds, so that neighbours can share characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.validate import ISO_4217
from tallyforge.schemas import MONEY, field

# The keywords that introduce a value, in order of preference at one place.
AMOUNT_ANCHORS = ["total", "amount due", "balance due", "gesamtbetrag", "total a pagar", "importe total", "montant total"]
DUE_ANCHORS = ["due", "pay by", "fällig", "vencimiento", "échéance"]
ISSUED_ANCHORS = ["invoice date", "date", "rechnungsdatum", "fecha"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Bytes between a keyword's end and the value it introduces, at most.
WINDOW = 40
ANCHORED, UNANCHORED = 90, 40
MARK, SEPARATOR = "\u0001", "\u0002"
#: Places in a block of running(), and the number of pairs up to which comparing each is faster than a pass in order.
BLOCK, PAIRS = 256, 64

_BEFORE = r"(?<=((?<![A-Za-z0-9])[A-Z]{3}\$|(?<![A-Za-z0-9]|[^\x00-\x7F])US\$|[€£]|(?<![A-Za-z0-9])[A-Z]{3})([  ]?))"
_AFTER = r"([  ]?)([A-Z]{3}\$|US\$|[€£]|[A-Z]{3}(?![A-Za-z0-9]))"
_NUMERAL = "([0-9]++(?:[.,  ][0-9]++)*+)"
#: Whole numerals with a marker on either side, as a numeral without one is no amount. A marker in front is a branch of its own, so its groups have numbers of their own.
AMOUNT = rf"(?=[0-9])(?<![0-9])(?<![0-9][.,  ])(?:{_BEFORE}{_NUMERAL}(?={_AFTER}|)|{_NUMERAL}(?={_AFTER}))"
#: Marker before, blank after it, numeral, blank, marker after.
AMOUNT_GROUPS = ["$1", "$2", "$3$6", "$4$7", "$5$8"]


#: What follows the decimal separator of a numeral that has one.
DECIMALS = r"(?s)^(?:(?=[^.]*\.)(?=[^,]*,).*[.,]|[^.,]*[.,](?=[0-9]{2}\z))([^.,]*)\z"


def _date_pattern() -> str:
    """The five shapes with real calendar dates only, so that a false one doesn't hide a date that begins inside it."""
    names = {n: f"(?:{n}|{n[:3]})" for n in MONTHS}
    long = [i for i, n in enumerate(MONTHS, 1) if i in (1, 3, 5, 7, 8, 10, 12)]
    short = [4, 6, 9, 11]
    leap = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
    year = r"[0-9]{4}"
    padded = {31: r"(?:0[1-9]|[12][0-9]|3[01])", 30: r"(?:0[1-9]|[12][0-9]|30)", 28: r"(?:0[1-9]|1[0-9]|2[0-8])", 29: "29"}
    free = {31: r"(?:0?[1-9]|[12][0-9]|3[01])", 30: r"(?:0?[1-9]|[12][0-9]|30)", 28: r"(?:0?[1-9]|1[0-9]|2[0-8])", 29: "29"}
    number = lambda months: "(?:" + "|".join(f"{m:02d}" for m in months) + ")"
    name = lambda months: "(?:" + "|".join(names[MONTHS[m - 1]] for m in months) + ")"
    groups = [(31, long, year), (30, short, year), (28, [2], year), (29, [2], leap)]
    shapes = [
        *(f"{y}-{number(m)}-{padded[d]}" for d, m, y in groups),
        *(f"{padded[d]}{sep}{number(m)}{sep}{y}" for sep in (r"\.", "/") for d, m, y in groups),
        *(f"{free[d]} {name(m)} {y}" for d, m, y in groups),
        *(f"{name(m)} {free[d]}, {y}" for d, m, y in groups),
    ]
    first = "|".join(n[:3] for n in MONTHS)
    # what every shape begins with, so that the shapes are tried at few places
    likely = rf"(?=[0-9JFMASOND])(?=[0-9]{{4}}-[0-9]{{2}}-|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]|[0-9]{{1,2}} [JFMASOND]|(?:{first})[a-z]{{0,6}} [0-9])"
    return f"(?i){likely}(?:" + "|".join(shapes) + ")"


DATE = _date_pattern()


def anchor_pattern(*lists: list[str]) -> str:
    """Where a keyword of any of the lists stands: matches without width, with a group for each list, so that keywords of several lists can share characters. A keyword
    inside another one of its list ends where that one does."""
    words = [rf"(?:{'|'.join(anchors)})(?![A-Za-z])" for anchors in lists]
    first = "".join(sorted({a[0] for anchors in lists for a in anchors}))
    return rf"(?i)(?<![A-Za-z])(?=[{first}])(?=" + "|".join(words) + ")" + "".join(f"(?=({w})|)" for w in words)


def unmarked(text: Column) -> Column:
    """The text without the marks of pieces(): those that it has become another control character of the same size."""
    return F.translate(text, MARK + SEPARATOR, "\u0004\u0004")


def pieces(text: Column, pattern: str, groups: list[str]) -> Column:
    """What stands before the first match, then for each match its groups and what stands between it and the next one, as arrays, in one pass over the text, which is unmarked()."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(MARK + SEPARATOR.join([*groups, ""])))
    return F.transform(F.split(marked, MARK, -1), lambda p: F.split(p, SEPARATOR, -1))


def running(first: Column, steps: Column) -> Column:
    """first, first + steps[0], first + steps[0] + steps[1], ...: as many as there are steps. Blocks of BLOCK keep the copying of arrays linear."""
    empty = F.array().cast("array<int>")
    start = F.struct(first.alias("at"), F.array().cast("array<array<int>>").alias("done"), empty.alias("block"))

    def put(acc: Column, step: Column) -> Column:
        full = F.size(acc["block"]) == BLOCK
        done = F.when(full, F.array_append(acc["done"], acc["block"])).otherwise(acc["done"])
        return F.struct((acc["at"] + step).alias("at"), done.alias("done"), F.array_append(F.when(full, empty).otherwise(acc["block"]), acc["at"]).alias("block"))

    # of a few steps, adding them up for each place anew is faster
    short = F.transform(steps, lambda _, i: F.aggregate(F.slice(steps, F.lit(1), i), first, lambda at, step: at + step))
    return F.when(F.size(steps) <= 8, short).otherwise(F.aggregate(steps, start, put, lambda acc: F.flatten(F.array_append(acc["done"], acc["block"]))))


def places(found: Column, token: int | None) -> Column:
    """Of pieces(): the byte offset of each match. token: the group that the match consists of, as it is the only one with a width; None if it has none."""
    each = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
    own = lambda p: F.octet_length(F.element_at(p, -1))
    steps = F.transform(each, own if token is None else lambda p: F.octet_length(F.get(p, F.lit(token))) + own(p))
    return running(F.octet_length(F.get(F.get(found, F.lit(0)), F.lit(0))), steps)


def matches_of(found: Column, names: list[str]) -> Column:
    """Of pieces(): the matches as structs of their groups by name."""
    each = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
    return F.transform(each, lambda p: F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def minor_units(token: Column) -> Column:
    """A numeral in hundredths. The decimal separator is the last of both kinds, or a lone one with two digits after it."""
    rest = F.regexp_extract(token, DECIMALS, 1)
    whole = F.regexp_replace(F.substring(token, F.lit(1), F.length(token) - F.length(rest)), "[^0-9]", "")
    cents = F.rpad(F.substring(rest, 1, 2), 2, "0")
    return F.when(cents.rlike("^[0-9]{2}$"), F.try_add(F.try_multiply(whole.try_cast("bigint"), F.lit(100).cast("bigint")), cents.try_cast("bigint")))


def marker_code(marker: Column) -> Column:
    return F.when(marker == "€", "EUR").when(marker == "£", "GBP").when(marker == "US$", "USD").otherwise(F.substring(marker, 1, 3))


def calendar_date(token: Column) -> Column:
    """A match of DATE as a date."""
    month = F.lower(F.regexp_extract(token, "([A-Za-z]{3})", 1))
    number = F.lpad(((F.instr(F.lit("".join(n[:3].lower() for n in MONTHS)), month) + 2) / 3).cast("int").cast("string"), 2, "0")
    named = F.concat(F.right(token, F.lit(4)), F.lit("-"), number, F.lit("-"), F.lpad(F.regexp_extract(token, "(?:^|[a-zA-Z] )([0-9]{1,2})", 1), 2, "0"))
    iso = (
        F.when(token.rlike("^[0-9]{4}-"), token)
        .when(token.rlike("^[0-9]{2}[./]"), F.concat(F.substring(token, 7, 4), F.lit("-"), F.substring(token, 4, 2), F.lit("-"), F.substring(token, 1, 2)))
        .otherwise(named)
    )
    return F.try_to_date(iso, "yyyy-MM-dd")


def amounts(found: Column, starts: Column) -> Column:
    """array<struct<value: money, start, end>> of the numerals with a currency. A marker after a numeral counts before one in front of it, even if it is no currency."""
    code_of = lambda m: F.when(m["after"] != "", marker_code(m["after"])).otherwise(marker_code(m["before"]))

    def one(m: Column, start: Column) -> Column:
        token, behind, ahead = m["token"], m["after"], m["before"]
        end = start + F.octet_length(token)
        first = F.when((behind == "") & (ahead != ""), start - F.octet_length(m["blank"]) - F.octet_length(ahead)).otherwise(start)
        last = F.when(behind != "", end + F.octet_length(m["gap"]) + F.octet_length(behind)).otherwise(end)
        return F.struct(F.struct(minor_units(token).alias("minor_units"), code_of(m).alias("currency")).alias("value"), first.alias("start"), last.alias("end"))

    # what is no currency goes before its numeral is read
    known = F.filter(F.zip_with(found, starts, lambda m, s: F.struct(m.alias("m"), s.alias("s"))), lambda p: code_of(p["m"]).isin(*ISO_4217))
    return F.filter(F.transform(known, lambda p: one(p["m"], p["s"])), lambda m: m["value"]["minor_units"].isNotNull())


def anchored(ends: Column, matches: Column, within: int = WINDOW) -> Column:
    """The first match in the window after the first keyword that has one: a range join inside the row, as one pass over both in order.

    That match is the first one whose nearest keyword before it is near enough: an earlier keyword with a match in its window would have an earlier match. The matches come in order."""
    none = F.get(F.filter(matches, lambda m: F.lit(False)), F.lit(0))
    last = F.struct(none["start"].alias("end"), none.alias("hit"))
    events = F.concat(F.transform(ends, lambda a: F.struct(a.alias("at"), F.lit(0).alias("kind"), none.alias("match"))), F.transform(matches, lambda m: F.struct(m["start"].alias("at"), F.lit(1).alias("kind"), m.alias("match"))))

    def step(acc: Column, event: Column) -> Column:
        near = acc["hit"].isNull() & (event["kind"] == 1) & (event["at"] - acc["end"] <= within)
        return F.struct(F.when(event["kind"] == 0, event["at"]).otherwise(acc["end"]).alias("end"), F.when(near, event["match"]).otherwise(acc["hit"]).alias("hit"))

    near = F.filter(matches, lambda m: F.exists(ends, lambda e: (m["start"] - e).between(0, within)))
    pairs = F.size(ends).cast("bigint") * F.size(matches)
    return F.when(pairs <= PAIRS, F.get(near, F.lit(0))).otherwise(F.aggregate(F.sort_array(events), last, step, lambda acc: acc["hit"]))


def as_field(match: Column, confidence: int, kind: Column, doc: Column, value_type: str) -> Column:
    span = F.struct(F.struct(kind.alias("kind"), doc.alias("doc")).alias("source"), match["start"].alias("start"), match["end"].alias("end"))
    return F.when(match.isNotNull(), F.struct(match["value"].alias("value"), F.lit(confidence).alias("confidence"), span.alias("span"))).cast(field(value_type))


def scan(df: DataFrame, column: str, out: str, kind: Column | int, doc: Column | None = None) -> DataFrame:
    """df with `out`: struct<amount, due, issued> of fields found in the text column. A null text has none."""
    t = F.col(column)
    kind = F.lit(kind) if isinstance(kind, int) else kind
    doc = doc if doc is not None else F.lit(None).cast("int")
    own = lambda name: f"_{out}_{name}"
    keys = {"amount": AMOUNT_ANCHORS, "due": DUE_ANCHORS, "issued": ISSUED_ANCHORS}
    groups = {"num": ["before", "blank", "token", "gap", "after"], "date": ["token"], "key": list(keys)}
    # without a digit there is nothing to find
    # one projection after another: each intermediate array is computed once
    step = df.withColumn(own("given"), F.when(t.rlike("[0-9]"), unmarked(t)))
    given = F.col(own("given"))
    step = step.withColumns({own("num"): pieces(given, AMOUNT, AMOUNT_GROUPS), own("date"): pieces(given, DATE, ["$0"]), own("key"): pieces(given, anchor_pattern(*keys.values()), ["$1", "$2", "$3"])})
    step = step.withColumns({own(f"{name}_at"): places(F.col(own(name)), {"num": 2, "date": 0, "key": None}[name]) for name in groups} | {own(f"{name}_found"): matches_of(F.col(own(name)), g) for name, g in groups.items()})
    both = lambda name: (F.col(own(f"{name}_found")), F.col(own(f"{name}_at")))
    dates = F.zip_with(*both("date"), lambda d, s: F.struct(calendar_date(d["token"]).alias("value"), s.alias("start"), (s + F.octet_length(d["token"])).alias("end")))
    ended = lambda name: F.zip_with(*both("key"), lambda k, s: F.when(k[name] != "", s + F.octet_length(k[name])))
    ends = {own(f"{name}_ends"): F.array_compact(ended(name)) for name in keys}
    step = step.withColumns({own("amounts"): amounts(*both("num")), own("dates"): F.filter(dates, lambda d: d["value"].isNotNull())} | ends)
    found = F.col(own("amounts"))
    largest = F.array_max(F.transform(found, lambda m: F.struct(m["value"]["minor_units"].alias("n"), m["start"].alias("s"), m.alias("m"))))["m"]
    step = step.withColumns({own("amount_hit"): anchored(F.col(own("amount_ends")), found), own("largest"): largest, own("due_hit"): anchored(F.col(own("due_ends")), F.col(own("dates")))})
    due = F.col(own("due_hit"))
    step = step.withColumn(own("other"), F.filter(own("dates"), lambda d: due.isNull() | (d["start"] != due["start"]) | (d["end"] != due["end"])))
    step = step.withColumn(own("issued_hit"), anchored(F.col(own("issued_ends")), F.col(own("other"))))
    amount = F.coalesce(as_field(F.col(own("amount_hit")), ANCHORED, kind, doc, MONEY), as_field(F.col(own("largest")), UNANCHORED, kind, doc, MONEY))
    issued = F.coalesce(as_field(F.col(own("issued_hit")), ANCHORED, kind, doc, "date"), as_field(F.get(F.col(own("other")), F.lit(0)), UNANCHORED, kind, doc, "date"))
    # a struct of columns, so that a field that nobody takes isn't looked for
    step = step.withColumns({own("amount"): amount, own("due"): as_field(due, ANCHORED, kind, doc, "date"), own("issued"): issued})
    step = step.withColumn(out, F.struct(*[F.col(own(name)).alias(name) for name in keys]))
    return step.drop(*[c for c in step.columns if c.startswith(f"_{out}_")])
