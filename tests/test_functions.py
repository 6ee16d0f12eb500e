"""Column functions against plain Python, and file sniffing."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import similarity as S
from plumbline.functions import text as X
from plumbline.sources import rowcsv, sniff


def values(spark, f, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_text(spark):
    ins = ["\t a \t", None, "  ", "N/A", " unknown ", "x"]
    assert values(spark, X.trimmed, ins) == ["a", "", "", "N/A", "unknown", "x"]
    assert values(spark, X.present, ins) == [True, False, False, False, False, True]
    assert values(spark, X.mask, ["CUS-00194", "john@x.com", "(555) 12-34", "Ab  Cd"]) == ["A-9", "a@a.a", "(9) 9-9", "Aa Aa"]
    assert values(spark, X.casing, ["ABC", "abc", "Abc Def", "abc Def", "JSmith", "12", ""]) == ["upper", "lower", "title", "mixed", "title", "none", "none"]
    assert values(spark, X.number, ["1,234.5", "$ 7", "-3", "12d", "nan", "", None, "1e3"]) == [1234.5, 7.0, -3.0, None, None, None, None, 1000.0]
    assert values(spark, X.shown, [None, " ", "a" * 300]) == ["(null)", "(blank)", "a" * 200]
    assert values(spark, X.unformula, ["#REF!", '="007"', " x ", "=5", None]) == [None, "007", " x ", "5", None]


def test_dates(spark):
    ins = ["2024-02-30", "2024-2-3", "03/04/2020", "04/25/2020", "25.12.2020", "5 Mar 2020", "5 march 2020", "Mar 5, 2020", "20200305", "5-mar-20", "05/03/70", "2024-01-01T10:00:00Z", "2024-01-01 10:00:00+02:00", "soon", ""]
    got = [d and d.isoformat() for d in values(spark, X.date, ins)]
    want = [None, "2024-02-03T00:00:00", "2020-04-03T00:00:00", "2020-04-25T00:00:00", "2020-12-25T00:00:00", *["2020-03-05T00:00:00"] * 5, "1970-05-03T00:00:00", "2024-01-01T10:00:00", "2024-01-01T08:00:00", None, None]
    assert got == want


@pytest.mark.parametrize(("a", "b", "want"), [("gmial.com", "gmail.com", 88.888), ("yaho.com", "yahoo.com", 94.117), ("", "", 100), ("a", "", 0)])
def test_ratio(a, b, want):
    assert S.ratio(a, b) == pytest.approx(want, abs=0.01)


def test_token_set():
    assert S.token_set("ada lovelace", "lovelace ada x") == 100
    assert S.token_set("abc", "xyz") == 0


def test_sniff_and_read(spark, tmp_path):
    lines = ["Report of July", "", "made by hand", 'id;name;"note"', *[f'{i};n{i};"two\nlines"' for i in range(40)], "99;x;y;too;long", "100;short"]
    path = tmp_path / "messy.csv"
    path.write_bytes(("﻿" + "\n".join(lines)).encode())
    got = rowcsv.read_csv(spark, str(path))
    assert got.dialect.encoding == "utf-8-sig" and got.dialect.delimiter == ";" and got.dialect.columns == ["id", "name", "note"]
    rows = got.df.orderBy("__row__").collect()
    assert len(rows) == 41 and got.dropped() == 1 and rows[-1].note is None and rows[0].note == "two\nlines"
    assert sniff.names_of([" a", "A", "", "b"]) == (["a", "A_1", "unnamed", "b"], ["column A occurs again"])
    assert sniff.delimiter_of("a\nb\n") == (",", 0.3)
    with pytest.raises(ValueError):
        sniff.encoding_of(b"")


def test_systematic(spark):
    df = spark.range(1000).withColumnRenamed("id", "__row__")
    assert rowcsv.systematic(df, above=100, target=100, first=0).count() == 100


def test_free_forms_of_dates(spark):
    """Named months, weekdays, ordinals and 12-hour clocks are read; what is no date is not."""
    forms = {
        "Monday, September 3, 2024": "2024-09-03 00:00:00", "Tue 3rd Sept 2024": "2024-09-03 00:00:00", "Mar 5 2023": "2023-03-05 00:00:00",
        "2024 Jan 9": "2024-01-09 00:00:00", "May 7, 2021 3:05 PM": "2021-05-07 15:05:00", "7 May 2021 at 12:30:15 am": "2021-05-07 00:30:15",
        "9/14/2024 11:59 pm": "2024-09-14 23:59:00", "25/12/2024 08:00": "2024-12-25 08:00:00", "December 31 1999, 23:59:59": "1999-12-31 23:59:59",
        "May 7, 2021 3:05 PM UTC": "2021-05-07 15:05:00", "7 May 2021 at 01:30 +02:00": "2021-05-06 23:30:00", "9/14/2024 23:59 -0130": "2024-09-15 01:29:00",
        "Mon, 3 Sep 2024 10:00:00 GMT": "2024-09-03 10:00:00", "Dec 31 1999 23:00 GMT-03": "2000-01-01 02:00:00", "May 7, 2021 3:05Z": "2021-05-07 03:05:00", "May 7, 2021 3:05 +9900": None,
        "May 7, 2021 13:05 PM": None, "Feb 30, 2024": None, "market 5 2023": None, "not a date": None, "may": None, "May 7, 2021 xyz": None, "": None,
    }
    got = spark.createDataFrame([(f,) for f in forms], "v string").select("v", X.date(F.col("v")).cast("string").alias("d"), X.date_format(F.col("v")).alias("f")).collect()
    assert {r.v: r.d for r in got} == forms
    assert {r.f for r in got if r.v and r.d} == {"other"}
