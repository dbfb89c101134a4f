"""Golden values of the scalar functions, derived by hand from their definitions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text, values


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("x")).collect()]


def test_titles(spark):
    rows = [(None,), ("",), ("\xa0 A\t\nB \x1c",), ("  x  ",), ("a  b",)]
    assert one(spark, rows, "t string", text.clean_title("t")) == ["", "", "A\t\nB", "x", "a  b"]
    assert one(spark, rows, "t string", text.normalize_title("t")) == ["", "", "a b", "x", "a b"]


def test_year(spark):
    rows = [("2024-05-01",), ("May 2024",), ("05-2024",), ("",), (None,), ("99999999999",)]
    assert one(spark, rows, "d string", text.year_of("d")) == [2024, None, 5, None, None, None]


def test_abstract(spark):
    rows = [("&lt;b&gt;x&lt;/b&gt;",), ("  \n ",), ("<p>A&nbsp;&amp; B</p>",), (None,), ("a < b",)]
    assert one(spark, rows, "a string", text.clean_abstract("a")) == ["x", None, "A & B", None, "a < b"]


def test_inverted_abstract(spark):
    rows = [({"a": [0], "b": [3]},), ({"a": []},), ({"a": [0], "b": [0], "c": [1]},), (None,), ({},)]
    got = one(spark, rows, "m map<string,array<int>>", text.inverted_abstract("m"))
    assert got == ["a b", None, "b c", None, None]


def test_dates(spark):
    rows = [("2024-05-01T10:00:00Z",), ("2024-05-01T10:00:00+02:00",), ("2024-05-01T10:00:00",), ("2024-05-01",), ("20240501",), ("2024",), ("2024-05",), ("x",), (None,), ("2024-13-01",)]
    got = one(spark, rows, "d string", F.unix_seconds(values.parse_date("d")))
    base = 1714521600
    assert got == [base + 36000, base + 28800, base + 36000, base, base, None, None, None, None, None]


def test_numbers(spark):
    rows = [("1",), (" 2.5 ",), ("nan",), ("-inf",), ("1_0",), ("1d",), ("x",), ("",), (None,), ("1e3",)]
    got = one(spark, rows, "v string", values.number("v"))
    assert got[:2] == [1.0, 2.5] and math.isnan(got[2]) and got[3] == -math.inf and got[4] == 10.0
    assert got[5:9] == [None] * 4 and got[9] == 1000.0


def test_log1p_and_limits(spark):
    rows = [(0.0,), (-1.0,), (-2.0,), (math.nan,), (math.inf,)]
    got = one(spark, rows, "v double", values.log1p(F.col("v")))
    assert got[0] == 0.0 and got[1] == -math.inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == math.inf
    assert one(spark, rows, "v double", values.at_least(F.col("v"), 0.75)) == [False, False, False, False, True]


def test_days_are_whole(spark):
    rows = [(dt.datetime(2024, 2, 29, 23, 59, 59),), (dt.datetime(2024, 2, 28, 23, 59, 59),), (dt.datetime(2025, 1, 1),), (None,)]
    got = one(spark, rows, "p timestamp", values.days_since("p", F.lit("2024-03-01 00:00:01")))
    assert got == [0, 1, 0, None]


def test_texts_and_hash(spark):
    df = spark.createDataFrame([("t", None, ["a", "b"], []), ("", "x", None, ["k"])], "title string, abstract string, creators array<string>, tags array<string>").coalesce(1)
    assert [r[0] for r in df.select(text.library_text()).collect()] == ["t\na; b", "x\nk"]
    import hashlib

    assert [r[0] for r in df.select(text.item_hash()).collect()] == [hashlib.sha256(x).hexdigest() for x in (b"ta,b", b"xk")]


def test_rfc822(spark):
    rows = [(dt.datetime(2024, 5, 1, 10),), (None,)]
    assert one(spark, rows, "p timestamp", values.rfc822("p", F.lit("2024-03-01 00:00:00"))) == ["Wed, 01 May 2024 10:00:00 +0000", "Fri, 01 Mar 2024 00:00:00 +0000"]


@pytest.mark.parametrize("text_, want", [("a" * 81, "a" * 80 + "…"), ("a" * 80, "a" * 80), (None, None)])
def test_shorten(spark, text_, want):
    assert one(spark, [({"k": text_},)], "m map<string,string>", text.shorten_values("m")["k"]) == [want]
