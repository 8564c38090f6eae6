"""Cell values to numbers and dates, derived rates, and number text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekloom.functions.text import strip

# possessive, so that texts of any length are read in one pass
DIGITS = r"\d++(?:_\d++)*+"
DECIMAL_TEXT = (rf"\A[+-]?(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?\z")


def parse_number(text: Column, tag: Column | None = None) -> Column:
    """Finite double, or null. Percent signs are dropped, parentheses negate."""
    if tag is not None:
        text = F.when(tag != "b", text)
    body = F.regexp_replace(strip(text), "[,%]", "")
    inner = F.regexp_replace(body, r"\A\(([\s\S]*)\)\z", "$1")
    digits = F.regexp_extract(strip(F.regexp_replace(inner, r"\A[$€£]", "")), DECIMAL_TEXT, 0)
    value = F.translate(digits, "_", "").try_cast("double")
    value = F.when(F.abs(value) < float("inf"), value)
    return value * F.when(body.rlike(r"\A\([\s\S]*\)\z"), -1.0).otherwise(1.0)


def to_integer(value: Column) -> Column:
    """Nearest integer when the value is one up to rounding noise, else null."""
    nearest = F.rint(value)
    slack = F.greatest(F.abs(value), F.abs(nearest), F.lit(1.0)) * 1e-9
    return F.when(F.abs(value - nearest) <= slack, nearest.try_cast("bigint"))


def parse_integer(text: Column, tag: Column | None = None) -> Column:
    return to_integer(parse_number(text, tag))


def parse_date(text: Column) -> Column:
    """The first 20yy-mm-dd in the text; null when absent or impossible."""
    return F.regexp_extract(text, r"20\d{2}-\d{2}-\d{2}", 0).try_cast("date")


def cell_reference(column: Column, row: Column) -> Column:
    """Spreadsheet address of a 1-based column and row, up to three letters."""
    def letter(index: Column) -> Column:
        return F.char(F.lit(65) + index)

    one, two, three = column - 1, column - 27, column - 703
    letters = (
        F.when(column <= 26, letter(one))
        .when(column <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26),
                            letter(three % 26))))
    return F.concat(letters, row.cast("string"))


def percent_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100.0


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def round6(value: Column) -> Column:
    return F.round(value, 6) + F.lit(0.0)


def number_text(value: Column, unit: Column, currency: Column) -> Column:
    two = F.format_number(value, 2)
    return (F.when(unit == "currency", F.concat(currency, F.lit(" "), two))
            .when((unit == "count") & (value == F.rint(value)), F.format_number(value, 0))
            .when(unit == "percentage_points", F.concat(two, F.lit("%")))
            .when(unit == "ratio", F.concat(two, F.lit("x")))
            .otherwise(two))


def period_token(start: Column, end: Column) -> Column:
    return F.concat(F.month(start).cast("string"), F.lit("."), F.dayofmonth(start).cast("string"),
                    F.lit("–"),
                    F.month(end).cast("string"), F.lit("."), F.dayofmonth(end).cast("string"))
