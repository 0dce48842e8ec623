"""Date and time expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.text import quote, strip

# Date text is rewritten to ISO text, so that one native cast, which never throws, reads it.  Text is
# a date, with a weekday name before it or a clock after it.  Month comes before day unless the first
# number cannot be a month; two-digit years up to 68 are of this century.
# The spellings of dates and clocks.
ISO_SHAPE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"
WEEKDAY = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
CLOCK = r"(?i)(?:[Tt]|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,9})?))?(?:\s*([ap])\.?m\.?)?\s*(z|utc|gmt|[-+]\d{2}:?\d{2})?$"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
MONTH_FIRST = r"^(0?[1-9]|1[0-2])[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"
DAY_FIRST = r"^(1[3-9]|2\d|3[01])[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_MONTH = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
          r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?")
DAY_NAME_YEAR = rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[- ]{_MONTH},?[- ](\d{{4}}|\d{{2}})$"
NAME_DAY_YEAR = rf"(?i)^{_MONTH}[- ](\d{{1,2}})(?:st|nd|rd|th)?(?:, ?|[- ])(\d{{4}})$"
NAME_YEAR = rf"(?i)^{_MONTH},?[- ](\d{{4}})$"
# First letters of the month names, three each.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_MERIDIEM = r"(?:a\.?m\.?|p\.?m\.?)"
TIME_ONLY = [
    rf"(?i)^\d{{1,2}}:\d{{2}}(:\d{{2}})?\s*{_MERIDIEM}?$",
    rf"(?i)^\d{{1,2}}\s*{_MERIDIEM}$",
]
TIME_INSIDE = rf"(?i)(\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s*{_MERIDIEM}?|\d{{1,2}}\s*{_MERIDIEM})"
# Text that means "no time".
NO_TIME = ["nan", "none", "nat", ""]

# Strftime directive -> Spark date pattern.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD",
}


def _month_number(name: Column) -> Column:
    return ((F.instr(F.lit(MONTHS), F.lower(F.left(name, F.lit(3)))) + 2) / 3).cast("int").cast("string")


def _year(digits: Column) -> Column:
    century = F.when(digits <= "68", "20").otherwise("19")
    return F.when(F.length(digits) == 2, F.concat(century, digits)).otherwise(digits)


def iso_date(text: Column) -> Column:
    """ISO text of a date without clock, NULL for other shapes."""
    def read(shape: str, year: int, month: int, day: int | None, named: bool = False):
        def part(i: int) -> Column:
            return F.regexp_extract(text, shape, i)

        found = _month_number(part(month)) if named else part(month)
        return text.rlike(shape), F.concat_ws("-", _year(part(year)), found, part(day) if day else F.lit("1"))

    shapes = [read(YEAR_FIRST, 1, 2, 3), read(MONTH_FIRST, 3, 1, 2), read(DAY_FIRST, 3, 2, 1), read(COMPACT, 1, 2, 3),
              read(DAY_NAME_YEAR, 3, 2, 1, named=True), read(NAME_DAY_YEAR, 3, 1, 2, named=True), read(NAME_YEAR, 2, 1, None, named=True)]
    # Only four shapes have no letter and only three have one.
    digits, names = (functools.reduce(lambda out, shape: out.when(*shape), own[1:], F.when(*own[0])) for own in (shapes[:4], shapes[4:]))
    return F.when(text.rlike("[A-Za-z]"), names).otherwise(digits)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once.  It stays out of the generated code, which would not
    compile with all spellings in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _clocked(bare: Column, date: Column) -> Column:
    def clock(i: int) -> Column:
        return F.regexp_extract(bare, CLOCK, i)

    hour, half = clock(1).cast("int"), F.lower(clock(4))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.when(clock(3) == "", "00").otherwise(F.left(clock(3), F.lit(9)))  # microseconds
    zone = F.when(F.lower(clock(5)).isin("z", "utc", "gmt"), "Z").otherwise(F.regexp_replace(clock(5), r"^(...)(\d\d)$", "$1:$2"))
    # A clock that cannot be is NULL, and so is the whole text.
    return F.concat(date, F.lit(" "), F.lpad(hour24.cast("string"), 2, "0"), F.lit(":"), clock(2), F.lit(":"), second, zone)


def iso_text(text: Column) -> Column:
    """ISO text of stripped date text, with its clock and zone; NULL for other shapes."""
    def read(bare: Column) -> Column:
        date = _let(F.regexp_replace(bare, CLOCK, ""), iso_date)
        clocked = bare.contains(":") & bare.rlike(CLOCK)  # the first test is cheap
        return F.when(clocked, _clocked(bare, date)).otherwise(iso_date(bare))

    # Only text that ends like a date, a clock or a zone is looked at closely.
    likely = text.rlike(r"(?i)(?:\d|[ap]\.?m\.?|z|utc|gmt)$")
    return F.when(text.rlike(ISO_SHAPE), F.translate(text, "/", "-")).when(likely, _let(F.regexp_replace(text, WEEKDAY, ""), read))


def to_timestamp(v: Column, dtype: T.DataType, formats: list[str] | None = None) -> Column:
    """Timestamp or NULL.

    Each value is read by the shape it has, or by the first of `formats` (Spark patterns) that
    fits.  (A reader that fixes the format by the first value would lose the others.)
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return v.cast("timestamp")
    if not isinstance(dtype, T.StringType):
        raise ValueError(f"cannot read {dtype.simpleString()} as a date")
    text = strip(v)
    if formats:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp")
    return iso_text(text).try_cast("timestamp")


def strftime_pattern(fmt: str) -> str:
    """Spark date pattern for a strftime format; unknown directives are an error."""
    out = []
    for directive, literal in re.findall(r"%(.)|([^%]+)", fmt):
        if directive == "%":
            out.append("'%'")
        elif directive:
            if directive not in STRFTIME:
                raise ValueError(f"unsupported date directive %{directive}")
            out.append(STRFTIME[directive])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group(0)}'", literal.replace("'", "''")))
    return "".join(out)


def is_time_text(v: Column) -> Column:
    """True when the whole stripped text is a time of day."""
    text = strip(v)
    return text.rlike(TIME_ONLY[0]) | text.rlike(TIME_ONLY[1])


def with_clock_time(df: DataFrame, column: str) -> DataFrame:
    """'2:35 p.m. (est.)' -> '14:35'.

    The first time inside the text wins.  Without a valid time a date becomes 'yyyy-MM-dd HH:mm';
    anything else stays as it is.  Hours are computed, not parsed, so no value throws.  Each
    regex result is a column of its own projection, so it is evaluated once per row.
    """
    def number(i: int) -> Column:
        digits = F.split_part("__digits", F.lit(":"), F.lit(i))
        # A try_cast that fails is slow, so empty text is not cast.
        return F.when(digits != "", digits.cast("int"))

    parts = (df.withColumn("__text", strip(quote(column)))
             .withColumn("__found", F.lower(F.regexp_extract("__text", TIME_INSIDE, 1)))
             .withColumn("__digits", F.regexp_replace("__found", "[^0-9:]", ""))
             .withColumns({"__h": number(1), "__m": F.coalesce(number(2), F.lit(0)), "__s": F.coalesce(number(3), F.lit(0)),
                           "__half": F.when(F.col("__found").contains("p"), "p").when(F.col("__found").contains("a"), "a")}))
    half, hour = F.col("__half"), F.col("__h")
    hour24 = F.when(half.isNull(), hour).when(hour <= 12, hour % 12 + F.when(half == "p", 12).otherwise(0))
    valid = (F.col("__found") != "") & (F.col("__h") <= 23) & (F.col("__m") <= 59) & (F.col("__s") <= 59)
    clock = F.concat(F.lpad(F.col("__h").cast("string"), 2, "0"), F.lit(":"), F.lpad(F.col("__m").cast("string"), 2, "0"))
    as_date = F.date_format(iso_text(F.col("__text")).try_cast("timestamp"), "yyyy-MM-dd HH:mm")
    result = (F.when(F.lower("__text").isin(NO_TIME), None).when(valid, clock)
              .otherwise(F.coalesce(as_date, quote(column))))
    return (parts.withColumn("__h", hour24).withColumn(column, result)
            .drop("__text", "__found", "__digits", "__h", "__m", "__s", "__half"))


def minutes_of_day(v: Column) -> Column:
    return F.hour(v) * 60 + F.minute(v)
