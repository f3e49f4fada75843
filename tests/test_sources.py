import pytest
from gleaner.functions import coerce, temporal
from gleaner.sources import text
from pyspark.sql import functions as F


#: Fixed values, here and below: texts and what they must be read as.
def test_quoted_text():
    p = text.parse_delimited('name,note\n"a, b","line 1\nline ""2"""\r\nc,d\r\n\n')
    assert p.columns == ["name", "note"] and p.rows == [["a, b", 'line 1\nline "2"'], ["c", "d"]]


def test_loose_quotes_and_line_ends():
    assert text.records('ab"c,d"e,f\rx,y', ",") == [["abc,de", "f"], ["x", "y"]]
    assert text.records('"",b', ",") == [["", "b"]]


def test_sniffing():
    for sep in (";", "\t", "|", ","):
        assert text.sniff(sep.join("abc") + "\n" + sep.join("123")) == sep
    assert text.sniff("only\none") == ","


def test_header_and_ragged_rows():
    p = text.parse_delimited("a,a,,a_2\n1,2\n1,2,3,4,5\nNULL,-,n/a,x")
    assert p.columns == ["a", "a_2", "column_3", "a_2_2"] and len(set(p.columns)) == 4
    assert p.rows == [["1", "2", None, None], ["1", "2", "3", "4"], [None, None, None, "x"]] and len(p.warnings) == 3


def test_json_forms():
    assert text.parse('[{"user": {"id": 1, "deep": {"x": {"y": 2}}}, "tags": ["a", "b"]}]').columns == ["user.id", "user.deep.x", "tags"]
    assert len(text.parse('{"a":1}\n{"a":2}\n{"a":3}').rows) == 3
    ragged = text.parse('{"rows": [{"a": 1}, {"b": true}, 5]}')
    assert ragged.columns == ["a", "b"] and ragged.rows == [["1", None], [None, "true"]] and len(ragged.warnings) == 2
    with pytest.raises(text.IngestError):
        text.parse_json("{broken")


def values(spark, xs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, raw string")
    return [r["v"] for r in df.select("i", f(F.col("raw")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    xs = ["1 234,56", "1,234.56", "1.234,56", "$1,200", "(500)", "12,5%", "1,234", "1,23", "не число", "", "1 234", "5.", "1e400", None, " -3 ", "(-3)", "€-7"]
    assert values(spark, xs, coerce.number_of) == [1234.56, 1234.56, 1234.56, 1200, -500, 0.125, 1234, 1.23, None, None, 1234, None, None, None, -3, 3, -7]


def test_dates(spark):
    f = lambda day_first: lambda c: F.date_format(coerce.date_of(c, day_first), "yyyy-MM-dd HH:mm")
    xs = ["2025-03-15", "2025-03-15T10:30:00Z", "25/03/2025", "01/03/2025", "не дата", "01.03.2025 9:05", "2025-13-01", "2025-03-15T10:30+0330"]
    assert values(spark, xs, f(True)) == ["2025-03-15 00:00", "2025-03-15 10:30", "2025-03-25 00:00", "2025-03-01 00:00", None, "2025-03-01 09:05", None, "2025-03-15 07:00"]
    assert values(spark, xs[2:4], f(False)) == [None, "2025-01-03 00:00"]


@pytest.mark.parametrize("day_first", [False, True])
def test_date_test_agrees_with_reading(spark, day_first):
    xs = ["2025-03-15", "2025-02-31", "2025-13-01", "2025-00-10", "0000-01-01", "2025-03-15T23:59:59.123Z", "2025-03-15T24:00", "2025-03-15 10:61", "2025-03-15T10:30+0330", "2025-03-15Z", "1/2/2025", "13/2/2025", "2/13/2025", "0/1/2025", "32.1.2025",
          "1.2.0000", "1/2/2025 99:99", "1/2/25", "2025/99/99", "2025.1.2", "2025-7", "2025-99", "0999999999", "1000000000", "4102444800", "631152000000", "1700000000000", "17000000000", "20250315", "x", ""]
    df = spark.createDataFrame([(x,) for x in xs], "s string")
    for r in df.select("s", coerce.date_of(F.col("s"), day_first).isNotNull().alias("read"), coerce.is_date(F.col("s"), day_first).alias("test")).collect():
        assert r["read"] == r["test"], r


def test_booleans_and_names(spark):
    assert values(spark, ["Да", "нет", "Y", "0", "maybe", None], coerce.boolean_of) == [True, False, True, False, None, None]
    assert [coerce.looks_like_id(n) for n in ("id", "order_id", "o_orderkey", "user key", "valid")] == [True, True, False, True, False]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id;amount;id\n1;"1 000,5";x\n2;-\n3;7;y;z\n', encoding="utf-8")
    df, warnings = text.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "amount", "id_2"] and len(warnings) == 2 and warnings[1].startswith("2 rows")
    assert sorted(map(tuple, df.collect())) == [("1", "1 000,5", "x"), ("2", None, None), ("3", "7", "y")]
    (tmp_path / "b.json").write_text('{"u": {"id": 1}, "t": ["a", "b"]}\n{"u": {"id": 2}, "v": true}\n')
    back = text.read_json(spark, str(tmp_path / "b.json"))
    assert sorted(back.columns) == ["t", "u.id", "v"] and back.count() == 2


@pytest.mark.parametrize("grain", ["hour", "day", "week", "month", "quarter", "year"])
def test_driver_and_column_calendar_agree(spark, grain):
    moments = ["2024-02-29 23:59:59", "2024-12-30 00:00:00", "2025-01-01 12:00:00", "1999-07-04 06:30:00"]
    df = spark.createDataFrame([(m,) for m in moments], "m string").select(F.to_timestamp("m").alias("t"))
    start = temporal.bucket(F.col("t"), grain)
    for r in df.select("t", start.alias("b"), temporal.label(start, grain).alias("l")).collect():
        assert temporal.truncate(r["t"], grain) == r["b"] and temporal.format_label(r["b"], grain) == r["l"]
        assert temporal.truncate(temporal.following(r["b"], grain), grain) == temporal.following(r["b"], grain) > r["t"]


def test_ragged_rows_of_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,2,3\n1,2\n1,2,3,4\n"x, y",2,3\n')
    df, warnings = text.read_delimited(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3"), ("1", "2", None), ("1", "2", "3"), ("x, y", "2", "3")]
    assert warnings == ["2 rows have another number of fields than the header."]
    assert text.read_delimited(spark, str(tmp_path / "t.csv"), count_ragged=False)[1] == []
