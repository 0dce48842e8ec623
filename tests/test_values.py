"""Value expressions against hand-computed answers."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions import datetimes, numbers, text
from limpid.operators import columns


def test_strip_removes_unicode_whitespace(column, values):
    df = column([" a ", " a b\t\n", "　", None])
    assert values(columns.strip_whitespace(df, "v")) == ["a", "a b", "", None]


def test_normalize_nulls(column, values):
    df = column(["  ", "N/A", " N/A ", "x", "", None, "none"])
    assert values(columns.normalize_nulls(df)) == [None, None, " N/A ", "x", None, None, None]


def test_nan_is_null(column, values):
    assert values(columns.normalize_nulls(column([1.0, float("nan"), None], "double"))) == [1.0, None, None]


def test_title_case(column, values):
    df = column(["o'neil 3rd-street éCOLE", None])
    assert values(columns.clean_text(df, "v", case="title")) == ["O'Neil 3Rd-Street École", None]


def test_remove_chars_treats_them_literally(column, values):
    df = column(["$1,2]3^4-5\\6", None])
    assert values(columns.clean_text(df, "v", "$,]^-\\")) == ["123456", None]


def test_number_grammar(column, values):
    df = column(["1e3", " 12 ", "3.7", "-5.", ".5", "+3", "1f", "0x10", "1_000", "1,000", "True", "1e400", "inf", None])
    assert values(columns.cast_type(df, "v", "float")) == [1000, 12, 3.7, -5, 0.5, 3] + [None] * 8


def test_cast_int_truncates_and_defaults_to_zero(column, values):
    df = column(["3.7", "-3.7", "abc", None, "9007199254740993", "1e400"])
    assert values(columns.cast_type(df, "v", "int")) == [3, -3, 0, 0, 9007199254740993, 0]
    assert values(columns.cast_type(column([1.9, None, float("inf")], "double"), "v", "int")) == [1, 0, 0]


def test_cast_unknown_type_is_an_error(column):
    with pytest.raises(ValueError):
        columns.cast_type(column(["a"]), "v", "complex")


def test_dates_in_mixed_formats(column, values):
    df = column(["2020-01-02", "03/04/2020", "Jan 5 2020", "25/12/2020", "8 September 1960", "January 5, 2020",
                 "2020-01-02 03:04:05", "20200102", "2020-02-30", "x", None])
    got = values(columns.cast_type(df, "v", "datetime", ["pos"]))
    day = datetime.datetime
    assert got == [day(2020, 1, 2), day(2020, 3, 4), day(2020, 1, 5), day(2020, 12, 25), day(1960, 9, 8), day(2020, 1, 5),
                   day(2020, 1, 2, 3, 4, 5), day(2020, 1, 2), None, None, None]


def test_format_datetime_quotes_literals(column, values):
    df = column(["2020-01-02", "x"])
    assert values(columns.format_datetime(df, "v", "%d.%m.%YT%j%%", ["pos"])) == ["02.01.2020T002%", None]
    with pytest.raises(ValueError):
        columns.format_datetime(df, "v", "%Q", ["pos"])


TIMES = {
    "2:35 p.m.": "14:35", "2:35PM": "14:35", "14:30": "14:30", "3 AM": "03:00", "7 p.m.": "19:00", "12:05 a.m.": "00:05",
    "0:15 AM": "00:15", "12:00 pm": "12:00", "23:59:59": "23:59", "2:35 pm (Estimated runway)": "14:35",
    "25:00": "25:00", "14:30 PM": "14:30 PM", "noon": "noon", "nan": None, " None ": None, "": None,
    "2011-12-01 10:30": "10:30", "2011-12-01": "2011-12-01 00:00",
}


def test_clock_times(column, values):
    df = column([*TIMES, None])
    assert values(columns.standardize_time(df, "v")) == [*TIMES.values(), None]


@pytest.mark.parametrize("hits, expected", [(12, False), (13, True), (0, False)])
def test_time_only_needs_more_than_sixty_percent(column, hits, expected):
    df = column([None, *["2:35 p.m."] * hits, *["later"] * (20 - hits), *["3 AM"] * 40])
    row = columns.is_time_only(df, "v", ["pos"]).first()
    assert (row["sampled"], row["is_time_only"]) == (20, expected)


def test_time_column_becomes_clock_times_not_dates(column, values):
    df = column(["2:35 p.m.", "7 AM"])
    assert values(columns.cast_type(df, "v", "datetime", ["pos"])) == ["14:35", "07:00"]
    assert values(columns.format_datetime(df, "v", order_by=["pos"])) == ["14:35", "07:00"]


def test_comma_split_keeps_thousands(column):
    df = columns.split_column(column(["a, b,1,000", "c", "x,", None]), "v")
    assert df.columns == ["pos", "v_part1", "v_part2", "v_part3"]
    assert [tuple(r)[1:] for r in df.orderBy("pos").collect()] == [
        ("a", "b", "1,000"), ("c", None, None), ("x", "", None), (None, None, None)]


def test_pipe_is_literal_and_names_are_used_if_enough(column):
    df = columns.split_column(column(["c|d"]), "v", "|", ["left", "right", "spare"])
    assert [tuple(r) for r in df.collect()] == [(0, "c", "d")]
    assert columns.split_column(column(["c|d"]), "v", "|", ["only"]).columns == ["pos", "v_part1", "v_part2"]


def test_split_refuses_to_duplicate_a_column(column):
    with pytest.raises(ValueError):
        columns.split_column(column(["a|b"]), "v", "|", ["pos", "x"])


def test_extract(column, values):
    df = column(["8 September 1960 (USA)", "x", None])
    assert values(columns.extract_pattern(df, "v", "([0-9]+ [A-Za-z]+ [0-9]{4})")) == ["8 September 1960", None, None]
    assert values(columns.extract_pattern(df, "v", "[0-9]{4}")) == ["1960", None, None]
    assert values(columns.extract_pattern(df, "v", "(?P<y>[0-9]{4}")) == ["1960", None, None]
    with pytest.raises(ValueError):
        columns.extract_pattern(df, "v", "([a-z])([0-9])")


def test_replace_is_typed(column, values):
    assert values(columns.replace(column([-999, 1], "int"), "v", "-999", "NaN")) == [None, 1]
    assert values(columns.replace(column([" ? ", "?", "a?", None]), "v", "?", "b")) == ["b", "b", "a?", None]


def test_canonical_cells(column):
    df = column([" 1.0 ", "1", "0.00001", "1.23456", "AbC ", "nan", "-0.0", None])
    got = [r["c"] for r in df.withColumn("c", numbers.canonical(F.col("v"), T.StringType())).orderBy("pos").collect()]
    assert got == ["1", "1", "0", "1.2346", "abc", "nan", "0", None]


def test_same_cell_across_types(spark):
    df = spark.createDataFrame([(1, 1.0, "1.0", True), (2, 2.00001, " 2 ", False), (None, None, None, None)], "i int, d double, s string, b boolean")
    same = numbers.same_cell
    i, d, s = T.IntegerType(), T.DoubleType(), T.StringType()
    row = [tuple(r) for r in df.select(same(F.col("i"), i, F.col("d"), d), same(F.col("i"), i, F.col("s"), s),
                                       same(F.col("d"), d, F.col("s"), s), same(F.col("b"), T.BooleanType(), F.col("s"), s)).collect()]
    assert row == [(True, True, True, False), (True, True, True, False), (True, True, True, True)]


def test_count_of(column, values):
    df = column(["a,b,,c", "", " - - - ", None])
    assert values(df.withColumn("v", text.count_of(F.col("v"), ","))) == [3, 0, 0, None]
    assert values(df.withColumn("v", text.count_of(F.col("v"), " - "))) == [0, 0, 2, None]


def test_minutes_of_day(spark):
    df = spark.sql("SELECT timestamp'2020-01-01 13:05:59' AS t")
    assert df.select(datetimes.minutes_of_day(F.col("t"))).first()[0] == 785


@pytest.mark.parametrize("text, want", [
    ("2011-12-01T10:30:00Z", "2011-12-01 10:30:00"), ("2011-12-01 6:03 p.m.", "2011-12-01 18:03:00"), ("12/01/2011 6:03 PM", "2011-12-01 18:03:00"),
    ("01.12.2011", "2011-01-12 00:00:00"), ("13.12.2011", "2011-12-13 00:00:00"), ("1-Dec-2011", "2011-12-01 00:00:00"), ("1-Dec-11", "2011-12-01 00:00:00"),
    ("Dec 1, 2011 10:30", "2011-12-01 10:30:00"), ("12/01/11", "2011-12-01 00:00:00"), ("12/01/69", "1969-12-01 00:00:00"), ("Thu, 01 Dec 2011", "2011-12-01 00:00:00"),
    ("Dec 2011", "2011-12-01 00:00:00"), ("2011-12-01T10:30:00+02:00", "2011-12-01 08:30:00"), ("2011-12-01 10:30:00.25 +0530", "2011-12-01 05:00:00"),
    ("sept. 3rd, 2011", "2011-09-03 00:00:00"), ("20111201 12:05 am", "2011-12-01 00:05:00"), ("2011-02-30", None), ("12/01/2011 13:00 PM", None),
    ("2011-12-01 25:00", None), ("10:30", None), ("Dec", None), ("around 2011", None), ("", None), (None, None), ("12.5", None), ("1234567", None)])
def test_date_spellings(column, values, text, want):
    df = column([text])
    read = F.date_format(datetimes.to_timestamp(F.col("v"), df.schema["v"].dataType), "yyyy-MM-dd HH:mm:ss")
    assert values(df.withColumn("v", read)) == [want]
