"""Cell references, number formats, serial dates and raw values as Column expressions (JVM-side throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def a1_column(ref: Column) -> Column:
    """0-based column of a reference such as AA10: its letters, in either case; 0 without letters."""
    letters = F.upper(F.regexp_extract(ref, "^([A-Za-z]*)", 1))
    codes = F.filter(F.split(letters, ""), lambda c: c != "")
    return F.greatest(F.aggregate(codes, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1, F.lit(0))


def a1_row(ref: Column) -> Column:
    """0-based row of a reference: its digits; 0 without digits."""
    digits = F.regexp_extract(ref, "^[A-Za-z]*([0-9]+)", 1)
    return F.greatest(F.coalesce(digits.try_cast("int"), F.lit(0)) - 1, F.lit(0))


def dimension(ref: Column) -> Column:
    """A struct (start_row, start_col, end_row, end_col), 0-based and inclusive, of a reference or a range; null for more than two parts."""
    parts = F.split(ref, ":")
    end = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    start = F.get(parts, F.lit(0))
    found = F.struct(a1_row(start).alias("start_row"), a1_column(start).alias("start_col"), a1_row(end).alias("end_row"), a1_column(end).alias("end_col"))
    return F.when(F.size(parts) <= 2, found)


def is_date_code(code: Column) -> Column:
    """Whether a custom number format shows dates: a letter of y m d h s, and neither 0 nor #."""
    return F.lower(code).rlike("[ymdhs]") & ~code.rlike("[0#]")


def is_date_id(number: Column, custom: list[int] | None = None) -> Column:
    """Whether a number format id shows dates: built-in 14 to 22 and 45 to 47, or one of the custom ids."""
    found = number.between(14, 22) | number.between(45, 47)
    return found | number.isin(custom) if custom else found


def serial_to_timestamp(serial: Column) -> Column:
    """Spreadsheet serial (1900 system) to a timestamp without zone, to the millisecond."""
    v = serial.cast("double")
    days = F.floor(v)
    shift = F.when(days > 60, -25569).when(days >= 1, -25568).otherwise(-25569)
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    part = (v - whole) * 86_400_000
    ms = F.when(part < 0, -F.floor(-part + 0.5)).otherwise(F.floor(part + 0.5))
    return F.timestamp_micros(((days + shift) * 86_400_000 + ms) * 1000).cast("timestamp_ntz")


def serial_parts(serial: Column) -> Column:
    """A struct (year, month, day, hour, minute, second, ms) of a serial of 0 or more. Serial 60 is the day that the format has and the calendar has not, 29 February 1900; 0 is the day before 1 January 1900."""
    v = serial.cast("double")
    t = serial_to_timestamp(v)
    leap, zero = (v >= 60) & (v < 61), (v >= 0) & (v < 1)
    day = lambda part, on_leap, on_zero: F.when(leap, on_leap).when(zero, on_zero).otherwise(part(t)).cast("int")
    return F.struct(
        day(F.year, 1900, 1899).alias("year"), day(F.month, 2, 12).alias("month"), day(F.dayofmonth, 29, 31).alias("day"),
        F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second"), (F.date_format(t, "SSS").cast("int")).alias("ms"),
    )


_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^(?i)[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^(?i)[+-]?(inf|infinity|nan)$"


def raw_value(text: Column, kind: Column) -> Column:
    """A struct (kind, int, float, text, bool) from a cell's text and its type attribute; shared strings are not looked up.

    b: false for exactly 0, else true. e: an error. str and inlineStr: text. d: an ISO date, as text. Anything else:
    a 64-bit integer, else a decimal number, else text. Null text is an empty cell.
    """
    t = F.coalesce(kind, F.lit(""))
    number = ~t.isin("b", "e", "str", "inlineStr", "d", "s")
    as_int = F.when(number & text.rlike(_INT), F.regexp_replace(text, r"^\+", "").try_cast("long"))
    low = F.lower(text)
    sign = F.when(low.startswith("-"), -1.0).otherwise(1.0)
    words = F.when(low.endswith("nan"), F.lit(float("nan"))).when(low.rlike("inf"), sign * float("inf"))
    as_float = F.when(number & as_int.isNull() & text.rlike(_FLOAT), F.coalesce(words, F.regexp_replace(text, r"^\+", "").try_cast("double")))
    name = (
        F.when(text.isNull(), "empty").when(t == "b", "bool").when(t == "e", "error").when(t == "d", "iso").when(t.isin("str", "inlineStr", "s"), "string")
        .when(as_int.isNotNull(), "int").when(as_float.isNotNull(), "float").otherwise("string")
    )
    return F.struct(
        name.alias("kind"), as_int.alias("int"), as_float.alias("float"),
        F.when(name.isin("string", "iso"), text).alias("text"), F.when(name == "bool", text != "0").alias("bool"),
    )


def as_text(value: Column) -> Column:
    """How a value reads in a header: booleans as true or false, whole numbers without a point, empty for null."""
    return F.coalesce(value.cast("string"), F.lit(""))
