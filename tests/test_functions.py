import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fiscalframe.functions import numbers
from fiscalframe.functions.dates import parse_italian_date
from fiscalframe.functions.strptime import grammar, read_strptime
from fiscalframe.operators.rules import DATE_FORMATS


def values(spark, make, texts, schema="x string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {schema}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


NUMBERS = {
    "1.234,56": 1234.56, "1 234,56": 1234.56, "1234,56": 1234.56, "1234.56": 1234.56, "0,00": 0.0,
    "€ 1.250,00": 1250.0, "-450,00": -450.0, "-1.234,56": -1234.56, "(1.234,56)": -1234.56, "+99,90": 99.9,
    "": None, "abc": None, "n/d": None, "-": None,
    "1.234": 1234.0, "12.34": 12.34, "1234.567": 1234.567, "1,234": None, "1.234.56": None, "1,234.56": None,
    "(450,00": None, "450,00)": None, "(-5)": -5.0, "--5": 5.0, "−7,5": -7.5, "()": None, "(": None,
    "1e5": 1e5, "1_000": 1000.0, "1__0": None, "1d": None, "0x1p3": None, "inf": math.inf, "-Infinity": -math.inf,
    "\t 12,5 \n": 12.5, "1 234,5": 1234.5, "- 7": -7.0, "1\t2": None, "١٢,٥": 12.5, "5.": 5.0, ".5": 0.5,
    "€\t 5": 5.0, "(€ 5,00 )": -5.0, "+-5": -5.0, "1" * 400: math.inf,
}


def test_numbers(spark):
    got = dict(zip(NUMBERS, values(spark, numbers.parse_italian_number, list(NUMBERS))))
    assert got == NUMBERS


def test_not_a_number_and_negative_zero(spark):
    nan, zero = values(spark, numbers.parse_italian_number, ["nan", "-0,00"])
    assert math.isnan(nan)
    assert zero == 0 and math.copysign(1, zero) == -1


DATES = {
    "15/03/2024": "2024-03-15", "15-03-2024": "2024-03-15", "2024-03-15": "2024-03-15", "15 marzo 2024": "2024-03-15",
    "1 dicembre 2023": "2023-12-01", "non una data": None, "1/4/2024": "2024-04-01", "15.03.24": "2024-03-15",
    "15/03/68": "2068-03-15", "15/03/69": "1969-03-15", "15/03/70": "1970-03-15", "31/02/2024": None,
    "15/03/202": None, "15/03-2024": None, "99 marzo 2024": "2024-03-99", "15MARZO2024 Roma": "2024-03-15",
    " 15/03/2024\n": "2024-03-15", "29/02/2024": "2024-02-29", "29/02/2023": None, "01/01/0000": None,
    "01/01/0999": "999-01-01", "15/03/2024x": None, "12024-03-15": None, "2024/3/5": "2024-03-05",
    "15 march 2024": "2024-03-15", "15 Mar 2024": "2024-03-15", "15 gen 2024": "2024-01-15", "": None, "32/01/2024": None,
    "15/13/2024": None, "00/01/2024": None,
}


def test_dates(spark):
    got = values(spark, lambda c: parse_italian_date(c, DATE_FORMATS), list(DATES))
    assert dict(zip(DATES, got)) == DATES


def test_formats_without_their_marks_are_not_tried(spark):
    """A format's regex runs only in texts that hold its marks; those in letters' case, spaces and %% are no hindrance."""
    from fiscalframe.functions.dates import _marks

    assert [_marks(f) for f in ("%d/%m/%Y", "%d.%m-%y", "%d %B %Y", "%%%dT%m", "%d%m%Y")] == [["/"], ["-", "."], [], ["%"], []]
    got = values(spark, lambda c: parse_italian_date(c, ["%dT%m%%%Y", "%d-%m.%Y", "%d %b %Y"]), ["1t2%1999", "1-2.0999", " 3 \u00a0 MAR 2001 ", "1/2/1999", None])
    assert got == ["1999-02-01", "999-02-01", "2001-03-03", None, None]


def test_date_formats_in_order(spark):
    """An impossible date in one format leaves the turn to the next."""
    got = values(spark, lambda c: parse_italian_date(c, ["%d/%m/%y", "%y/%m/%d"]), ["31/02/24", "05/02/24"])
    assert got == ["2031-02-24", "2024-02-05"]
    assert values(spark, lambda c: parse_italian_date(c, ["%d%m%Y", "%d %% %B"]), ["01022024", "3 % aprile"]) == [
        "2024-02-01",
        "1900-04-03",
    ]


FORMAT_PIECES = ["%d", "%m", "%Y", "%y", "%B", "%b", "%H", "%I", "%M", "%S", "%f", "%p", "%j", "%A", "%a", "%w", "%u", "%U", "%W", "%G", "%V", "%z", "%Z", "%%"]
USUAL_FORMATS = [
    "%d/%m/%Y %H:%M", "%A %d %B %Y", "%j/%Y", "%d/%m/%Y %I:%M:%S %p", "%Y-%m-%dT%H:%M:%S.%f%z", "%U %w %Y", "%W %u %Y", "%G-W%V-%u", "%a, %d %b %y", "%Y%m%d%H%M",
    "%d %m", "%H:%M", "%Y %y", "%y %Y", "%m %B %d %Y", "%S", "%d.%m.%Y alle %H e %M", "%j %y %Z",
]


def python_date(text, fmt):
    try:
        return str(datetime.strptime(text, fmt).date())
    except ValueError:
        return None


@pytest.mark.filterwarnings("ignore::DeprecationWarning")
def test_any_format_reads_as_in_python(spark):
    """Formats as used and at random, on texts that fit, nearly fit, or do not."""
    rng, cases = random.Random(31), []
    formats = list(USUAL_FORMATS)
    while len(formats) < 70:
        pieces = rng.sample(FORMAT_PIECES, rng.randint(1, 6))
        fmt = "".join(p + rng.choice(["", " ", "/", "-", ":", ". ", "  "]) for p in pieces)
        try:
            grammar(fmt)
        except ValueError:
            # What is rejected when the rules are loaded fails for every text.
            assert python_date(datetime(2024, 3, 5, 7, 8, 9).strftime(fmt), fmt) is None, fmt
            continue
        formats.append(fmt)
    for fmt in formats:
        texts = []
        for _ in range(40):
            day = datetime(rng.choice([1900, 1969, 2000, 2015, 2016, 2020, 2024, rng.randint(1000, 9999)]), 1, 1) + timedelta(days=rng.randrange(366), seconds=rng.randrange(86400))
            text = day.strftime(fmt)
            if rng.random() < 0.6:
                at = rng.randrange(len(text) + 1)
                text = text[:at] + rng.choice(["0", "6", "9", "1", " ", "", "x", "5", "3"]) + text[at + rng.randint(0, 1) :]
            texts.append(rng.choice([text, text.upper(), text.lower()]))
        cases.append((fmt, texts))
    hits = 0
    for k in range(0, len(cases), 10):
        some = cases[k : k + 10]
        rows = spark.createDataFrame([(i, n, t) for i, (_, texts) in enumerate(some) for n, t in enumerate(texts)], "i int, n int, text string")
        read = F.coalesce(*[F.when(F.col("i") == i, read_strptime(F.col("text"), fmt)) for i, (fmt, _) in enumerate(some)])
        for r in rows.select("i", "n", "text", read.cast("string").alias("date")).collect():
            expected = python_date(r.text, some[r.i][0])
            hits += expected is not None
            assert r.date == expected, (some[r.i][0], r.text)
    assert hits > 700


def test_names_are_italian_and_english(spark):
    got = values(spark, lambda c: parse_italian_date(c, ["%A %d %B %Y", "%a %d %b %Y"]), ["Lunedì 4 Marzo 2024", "MERCOLEDÌ 5 GIUGNO 2024", "monday 4 march 2024", "gio 7 mar 2024", "x 7 mar 2024"])
    assert got == ["2024-03-04", "2024-06-05", "2024-03-04", "2024-03-07", None]


@pytest.mark.parametrize("fmt", ["%c", "%x", "%X", "%d %d", "%Y-%V", "%G %V", "%G-%V-%u %j", "%d%", "%e", "%"])
def test_unsupported_date_format(fmt):
    from fiscalframe import ExtractionRules

    with pytest.raises(ValueError, match="Formato data"):
        ExtractionRules().merge({}, [fmt])


def test_number_formats_match_python(spark):
    samples = [
        0.0, -0.0, 0.125, 0.375, 1.005, 2.675, 1250.0, -450.0, 1234567.891, 12345678.9, 99999999.99, 1e15 + 0.5, 1e16,
        123456789012345680.0, 0.001, 0.0001, 0.00012, 0.00001, 1.5e-7, 1e22, float("nan"), float("inf"), -float("inf"),
    ]
    assert values(spark, numbers.two_decimals, samples, "x double") == [f"{v:.2f}" for v in samples]
    assert values(spark, numbers.comma_decimals, samples, "x double") == [f"{v:.2f}".replace(".", ",") for v in samples]
    assert values(spark, numbers.grouped_two_decimals, samples, "x double") == [f"{v:,.2f}" for v in samples]
    assert values(spark, numbers.shortest, samples, "x double") == [repr(v) for v in samples]


def test_sum_is_exact_and_loses_nothing(spark):
    totals = [0.1] * 10 + [-0.3, 1e20, 0.125, None]
    rows = spark.createDataFrame([(t,) for t in totals], "total double").withColumn(
        "total_dec", numbers.exact_cents(F.col("total"))
    )
    assert rows.filter("total_dec is null").count() == 3
    exact = rows.filter("total_dec is not null").agg(numbers.sum_of_totals(F.col("total"), F.col("total_dec"))).first()[0]
    assert exact == 0.7
    assert rows.agg(numbers.sum_of_totals(F.col("total"), F.col("total_dec"))).first()[0] == pytest.approx(1e20)
    assert rows.limit(0).agg(numbers.sum_of_totals(F.col("total"), F.col("total_dec"))).first()[0] == 0.0
