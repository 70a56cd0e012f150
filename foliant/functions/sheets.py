"""Column functions over spreadsheet cells: references, serial dates, number and percent display."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COL, MAX_ROW = 16_383, 1_048_575

#: Built-in format codes by id. Fixed values.
BUILTIN_FORMATS = {
    0: "General",
    1: "0",
    2: "0.00",
    3: "#,##0",
    4: "#,##0.00",
    9: "0%",
    10: "0.00%",
    11: "0.00E+00",
    12: "# ?/?",
    13: "# ??/??",
    14: "mm-dd-yy",
    15: "d-mmm-yy",
    16: "d-mmm",
    17: "mmm-yy",
    18: "h:mm AM/PM",
    19: "h:mm:ss AM/PM",
    20: "h:mm",
    21: "h:mm:ss",
    22: "m/d/yy h:mm",
    45: "mm:ss",
    46: "[h]:mm:ss",
    47: "mmss.0",
    48: "##0.0E+0",
    49: "@",
}


def cell_ref(ref: Column) -> Column:
    """'AA100' as a struct (row, col) from 0; null if it is no reference or beyond the last cell."""
    up = F.upper(ref)
    letters, digits = F.regexp_extract(up, "^([A-Z]{1,3})([1-9][0-9]{0,6})$", 1), F.regexp_extract(up, "^([A-Z]{1,3})([1-9][0-9]{0,6})$", 2)
    col = F.lit(0)
    for i in range(1, 4):
        col = F.when(F.char_length(letters) >= i, col * 26 + F.ascii(F.substring(letters, i, 1)) - 64).otherwise(col)
    row = F.try_to_number(digits, F.lit("9999999")).cast("int")
    good = (letters != "") & (col - 1 <= MAX_COL) & (row - 1 <= MAX_ROW)
    return F.when(good, F.struct((row - 1).alias("row"), (col - 1).cast("int").alias("col")))


def cell_name(row: Column, col: Column) -> Column:
    """The reference of a cell counted from 0."""
    c1, c2, c3 = F.pmod(col, F.lit(26)), F.pmod(F.floor(col / 26) - 1, F.lit(26)), F.floor((col - 26) / 676) - 1
    letter = lambda c: F.char(c.cast("long") + 65)
    letters = F.when(col < 26, letter(c1)).when(col < 702, F.concat(letter(c2), letter(c1))).otherwise(F.concat(letter(c3), letter(c2), letter(c1)))
    return F.concat(letters, (row + 1).cast("string"))


def serial_to_iso(serial: Column, epoch_1904: Column) -> Column:
    """A serial date as text. Serial 60 is 1900-02-29 as in the files themselves; days after it are off by one."""
    day = F.floor(serial).cast("int")
    part = serial - F.floor(serial)
    date_1900 = F.when(day < 1, F.lit(None).cast("string")).when(day == 60, F.lit("1900-02-29")).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), F.when(day > 60, day - 1).otherwise(day)).cast("string"))
    date = F.when(epoch_1904, F.date_add(F.lit("1904-01-01").cast("date"), day).cast("string")).otherwise(date_1900)
    seconds = F.least(F.round(part * 86400).cast("int"), F.lit(86399))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    time = F.concat(F.lit("T"), two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds % 3600 / 60)), F.lit(":"), two(seconds % 60))
    shown = F.when(part > 1e-10, F.concat(date, time)).otherwise(date)
    return F.when((serial < 0) | shown.isNull(), plain_double(serial)).otherwise(shown)


def plain_double(x: Column) -> Column:
    """A double in plain decimals, without a fraction if it has none (doubles of up to 15 digits)."""
    d = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(F.abs(x) < 1e15, d).otherwise(x.cast("string"))


def percent_places(code: Column) -> Column:
    """Digits 0 and # between the last dot and the percent sign."""
    before = F.regexp_extract(code, r"^([^%]*)%", 1)
    tail = F.regexp_extract(before, r"\.([^.]*)$", 1)
    return F.length(F.regexp_replace(tail, "[^0#]", ""))


def _number(values: pd.Series) -> pd.Series:
    def show(v: str | None) -> str | None:
        if v is None or "." not in v:
            return v
        try:
            n = float(v)
        except ValueError:
            return v
        if n != n or n in (float("inf"), float("-inf")):
            return v
        if n == int(n) and abs(n) < 2**63:
            return str(int(n))
        text = repr(n)
        if "e" in text:
            text = f"{n:.400f}".rstrip("0") if abs(n) < 1 else f"{n:f}"
        return text

    return values.map(show)


def number_display(value: Column) -> Column:
    """'1.50' as '1.5', '2.0' as '2'; text without a dot is left as it is.

    The shortest digits that give the same double are not a built-in, so values with a
    fraction go to Python; all others stay in the JVM.
    """
    whole = value.rlike(r"^-?[0-9]{1,15}\.0+$")
    simple = ~value.contains(".") | whole
    return F.when(simple, F.regexp_replace(F.regexp_replace(value, r"\.0+$", ""), "^-0$", "0")).otherwise(F.pandas_udf(_number, "string")(value))


def percent_display(value: Column, places: Column) -> Column:
    """A share as percent. Half-way cases are rounded in decimal."""
    return F.concat(F.when(places == 0, F.round(value * 100, 0).cast("decimal(38,0)").cast("string")).otherwise(F.format_number(F.round(value * 100, 2), "0.00")), F.lit("%"))


def is_date_id(fmt: Column) -> Column:
    return fmt.between(14, 22) | fmt.between(45, 47)


def is_date_code(code: Column) -> Column:
    """Year, day, hour, minute or second tokens outside brackets and quotes."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(code, r"\[[^\]]*\]", ""), '"[^"]*"', ""))
    return bare.rlike("yy|dd|hh|ss|mm") | bare.rlike("(^|[^a-z])d([^a-z]|$)") | bare.rlike("(^|[^a-z])h([^a-z]|$)")


def typed_display(kind: Column, raw: Column, inline: Column, shared: Column) -> Column:
    """The text of a cell by its type: shared string, boolean, inline or formula string, error, number."""
    return F.when(kind == "s", shared).when(kind == "b", F.when(raw.isin("1", "true"), "TRUE").otherwise("FALSE")).when(kind == "inlineStr", inline).when(kind.isin("str", "e"), raw).otherwise(raw)


def twips_to_points(twips: Column) -> Column:
    return twips / 20.0


def hex_colour(text: Column) -> Column:
    """'#RRGGBB' or 'RRGGBB' (or with alpha first: 'AARRGGBB') as a struct of three numbers; null if it is none."""
    t = F.regexp_replace(text, "^#", "")
    rgb = F.when(t.rlike("^[0-9A-Fa-f]{6}$"), t).when(t.rlike("^[0-9A-Fa-f]{8}$"), F.substring(t, 3, 6))
    part = lambda i: F.conv(F.substring(rgb, i, 2), 16, 10).cast("int")
    return F.when(rgb.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))
