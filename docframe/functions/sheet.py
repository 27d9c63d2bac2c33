"""Spreadsheet functions on columns: references, serial dates, typed and displayed values."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docframe.functions.counters import alphabetic

# Day 0 of both date systems; built-in number formats by id
EPOCH_1900, EPOCH_1904 = "1899-12-30", "1904-01-01"
BUILTIN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy",
    16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)",
    39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}


def column_name(col: Column) -> Column:
    """1 is A; empty below 1."""
    return F.coalesce(alphabetic(col), F.lit(""))


def cell_ref(row: Column, col: Column) -> Column:
    return F.concat(column_name(col), row.cast("long").cast("string"))


def column_number(letters: Column) -> Column:
    """A is 1; letters of any case."""
    each = F.transform(F.split(F.upper(letters), ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c) - 64).cast("long"))
    return F.aggregate(F.filter(each, lambda n: n > 0), F.lit(0).cast("long"), lambda a, n: a * 26 + n)


def parse_ref(ref: Column) -> Column:
    """struct(row, col) from 1, dollar signs and case ignored; null if malformed."""
    plain = F.replace(ref, F.lit("$"), F.lit(""))
    letters, digits = F.regexp_extract(plain, r"\A([A-Za-z]+)([0-9]+)\z", 1), F.regexp_extract(plain, r"\A([A-Za-z]+)([0-9]+)\z", 2)
    return F.when((letters != "") & (digits.cast("long") >= 1), F.struct(digits.cast("long").alias("row"), column_number(letters).alias("col")))


def parse_part_ref(ref: Column) -> Column:
    """struct(row, col) from 0, upper-case letters only; (-1, -1) if malformed, as sheet parts have it."""
    good = ref.rlike(r"\A[A-Z]+[0-9]+\z")
    row = F.regexp_extract(ref, r"([0-9]+)\z", 1).cast("long")
    fine = good & (row >= 1)
    return F.struct(F.when(fine, row - 1).otherwise(F.lit(-1)).cast("long").alias("row"), F.when(fine, column_number(F.regexp_extract(ref, r"\A([A-Z]+)", 1)) - 1).otherwise(F.lit(-1)).cast("long").alias("col"))


def serial_to_time(serial: Column, date1904: Column) -> Column:
    """A time without zone: whole days toward zero, seconds rounded half up."""
    days = F.when(serial < 0, F.ceil(serial)).otherwise(F.floor(serial))
    seconds = F.floor((serial - days) * 86400 + 0.5)
    epoch = F.when(date1904, F.lit(EPOCH_1904)).otherwise(F.lit(EPOCH_1900)).cast("timestamp_ntz")
    return epoch + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def time_to_serial(time: Column, date1904: Column) -> Column:
    epoch = F.when(date1904, F.lit(EPOCH_1904)).otherwise(F.lit(EPOCH_1900)).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, time.cast("timestamp_ntz")) / F.lit(86400e6)


def is_date_code(code: Column) -> Column:
    """Whether a number format shows a date or time: a letter of these outside quotes, escapes and brackets, or an elapsed time in brackets."""
    bare = F.regexp_replace(code, r'"[^"]*(?:"|\z)|\\.?', "")
    first = F.regexp_extract(bare, r"\A(?:\[(?!(?:[hH]+|[mM]+|[sS]+)\])[^\]]*\]|[^\[ydhsmYDHSM])*(\[(?:[hH]+|[mM]+|[sS]+)\]|[ydhsmYDHSM])", 1)
    return F.coalesce(first != "", F.lit(False))


def format_serial(serial: Column, code: Column, date1904: Column) -> Column:
    """yyyy-MM-dd, with HH:mm if the code has a time, HH:mm:ss if it has only that or the serial is below 1."""
    bare = F.lower(F.regexp_replace(code, r'"[^"]*(?:"|\z)|\\.?', ""))
    date, time = bare.rlike("[yd]"), bare.rlike("[hs]")
    t = serial_to_time(serial, date1904)
    return F.when((serial < 1) | (time & ~date), F.date_format(t, "HH:mm:ss")).when(time, F.date_format(t, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(t, "yyyy-MM-dd"))


def general_number(value: float) -> str:
    """A number as text: whole ones up to 1e15 plainly, others by the shortest digits, with an exponent below 1e-4 and from 1e6 on."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "+Inf" if value > 0 else "-Inf"
    if value == int(value) and abs(value) <= 1e15:
        return str(int(value))
    digits = repr(float(value))
    sign, body = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    mantissa, _, power = body.partition("e")
    whole, _, part = mantissa.partition(".")
    number = (whole + (part if part != "0" else "")).lstrip("0")
    exponent = (len(whole) - 1 if whole.strip("0") else -(len(part) - len(part.lstrip("0"))) - 1) + int(power or 0)
    number = number.rstrip("0") or "0"
    if exponent < -4 or exponent >= 6:
        return f"{sign}{number[0]}{'.' + number[1:] if len(number) > 1 else ''}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{number}"
    padded = number.ljust(exponent + 1, "0")
    return sign + padded[: exponent + 1] + ("." + padded[exponent + 1 :] if len(padded) > exponent + 1 else "")


@F.arrow_udf(StringType())
def general_text(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else general_number(v) for v in values.to_pylist()], pa.string())


def format_number(raw: Column, code: Column, date1904: Column) -> Column:
    """Dates by format_serial, per cent as the number times 100, all else plainly; what is no number stays as it is."""
    n = raw.try_cast("double")
    return F.when(n.isNull(), raw).when(is_date_code(code), format_serial(n, code, date1904)).when(F.contains(code, F.lit("%")), F.concat(general_text(n * 100), F.lit("%"))).otherwise(general_text(n))


def typed_value(kind: Column, raw: Column, shared: Column, code: Column, date1904: Column) -> Column:
    """struct(kind, s, f, b, t) of a cell by its type: s, str, inlineStr, b, e, or a number."""
    n, none = raw.try_cast("double"), F.lit(None)
    make = lambda k, s=none, f=none, b=none, t=none: F.struct(F.lit(k).alias("kind"), s.cast("string").alias("s"), f.cast("double").alias("f"), b.cast("boolean").alias("b"), t.cast("timestamp_ntz").alias("t"))
    return (
        F.when(kind == "s", make("string", s=F.coalesce(shared, F.lit(""))))
        .when(kind.isin("str", "inlineStr"), make("string", s=raw))
        .when(kind == "b", make("bool", b=raw == "1"))
        .when(kind == "e", make("error", s=raw))
        .when(F.trim(F.coalesce(raw, F.lit(""))) == "", make("empty"))
        .when(n.isNull(), make("string", s=raw))
        .when(is_date_code(code), make("date", f=n, t=serial_to_time(n, date1904)))
        .otherwise(make("number", f=n))
    )


def normalise_rgb(value: Column) -> Column:
    """Upper case; the last six of eight digits; empty unless six are left."""
    v = F.upper(F.trim(value))
    return F.when(F.length(v) == 8, F.substring(v, 3, 6)).when(F.length(v) == 6, v).otherwise("")


REFERENCE = re.compile(r"(?<![A-Za-z0-9_.$])(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_.(])")
OPAQUE = re.compile(r"\"(?:[^\"]|\"\")*\"?|'(?:[^']|'')*'?")


def shift_formula(source: str, rows: int, columns: int) -> str:
    """References moved by so many rows and columns; fixed parts stay; strings and quoted sheet names are opaque. Those that leave the sheet are #REF!."""

    def moved(m: re.Match) -> str:
        fixed_col, letters, fixed_row, digits = m.groups()
        col = 0
        for c in letters.upper():
            col = col * 26 + ord(c) - 64
        col, row = col + (0 if fixed_col else columns), int(digits) + (0 if fixed_row else rows)
        if col < 1 or row < 1:
            return "#REF!"
        name = ""
        while col:
            col, rest = divmod(col - 1, 26)
            name = chr(65 + rest) + name
        return f"{fixed_col}{name}{fixed_row}{row}"

    out, at = [], 0
    for m in OPAQUE.finditer(source):
        out += [plain_shift(source[at : m.start()], moved), m[0]]
        at = m.end()
    return "".join([*out, plain_shift(source[at:], moved)])


def plain_shift(part: str, moved) -> str:
    # a run of letters and digits such as SUM2020 is a reference too: three letters and a number
    return REFERENCE.sub(moved, part)


@F.arrow_udf(StringType())
def shifted(formulas: pa.Array, rows: pa.Array, columns: pa.Array) -> pa.Array:
    return pa.array([None if f is None else shift_formula(f, r or 0, c or 0) for f, r, c in zip(formulas.to_pylist(), rows.to_pylist(), columns.to_pylist())], pa.string())
