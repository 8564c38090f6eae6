"""Text normalisation as Column expressions; Python only sees text that is not ASCII."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# every character Unicode calls white space, usable inside [...]
SPACE = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
ASCII_SPACE = r" \t-\r\x1c-\x1f"
SPACE_CHARACTERS = "".join(chr(c) for c in [
    *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000])
WORD = r"\p{L}\p{N}_"
ASCII = r"\A[\x00-\x7F]*\z"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def _normalized(values: pd.Series) -> pd.Series:
    return values.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).split()).casefold(),
                      na_action="ignore")


@F.pandas_udf(StringType())
def _normalized_header(values: pd.Series) -> pd.Series:
    return values.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).replace(
        "\ufeff", "").split()).casefold(), na_action="ignore")


def _beyond_ascii(col: Column, udf, ascii_form: Column) -> Column:
    """Ship only non-ASCII values to Python; ASCII rows travel as nulls."""
    plain = col.rlike(ASCII)
    return F.when(plain, ascii_form).otherwise(udf(F.when(~plain, col)))


def nfkc(col: Column) -> Column:
    return _beyond_ascii(col, _nfkc, col)


def casefold(col: Column) -> Column:
    return _beyond_ascii(col, _casefold, F.lower(col))


def nfkc_casefold(col: Column) -> Column:
    return _beyond_ascii(col, _nfkc_casefold, F.lower(col))


def squeeze(col: Column) -> Column:
    return F.regexp_replace(col, f"[{SPACE}]+", " ")


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(SPACE_CHARACTERS))


def is_blank(col: Column) -> Column:
    return col.isNull() | ~col.rlike(f"[^{SPACE}]")


def _ascii_form(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), f"[{ASCII_SPACE}]+", " "))


def normalize_text(col: Column) -> Column:
    return F.coalesce(_beyond_ascii(col, _normalized, _ascii_form(col)), F.lit(""))


def normalize_header(col: Column) -> Column:
    return F.coalesce(_beyond_ascii(col, _normalized_header, _ascii_form(col)), F.lit(""))


def clean_keyword(col: Column) -> Column:
    """Peel matching outer quotes and white space; null when nothing is left."""
    text = strip(col)
    lead = F.regexp_extract(text, rf'\A["{SPACE}]*', 0)
    peels = F.sequence(F.lit(1), F.greatest(F.length(lead), F.lit(1)))
    bare = F.aggregate(
        peels, text,
        lambda s, _: F.when(s.rlike(r'\A"[\s\S]*"\z'),
                            strip(s.substr(F.lit(2), F.length(s) - 2))).otherwise(s))
    return F.when(bare != "", bare)


def entity_token(*parts: Column) -> Column:
    joined = F.concat_ws("\x1f", *parts)
    slug = F.regexp_replace(F.regexp_replace(casefold(joined), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.substring(slug, 1, 36)
    return F.concat(F.when(slug == "", F.lit("entity")).otherwise(slug), F.lit("-"),
                    F.substring(F.sha2(joined, 256), 1, 10))


def safe_name(col: Column) -> Column:
    """Upper-case file name component of at most 80 characters; null if nothing is left."""
    text = F.upper(strip(nfkc(col)))
    for pattern in (r"[\\/:\x00-\x1f\x7f]+", f"[{SPACE}]+", f"[^{WORD}-]+", "_+"):
        text = F.regexp_replace(text, pattern, "_")
    text = F.regexp_replace(text, "^[_-]+|[_-]+$", "")
    return F.when(text != "", F.substring(text, 1, 80))


def report_stem(market: Column, start: Column, end: Column) -> Column:
    return F.concat(safe_name(market), F.lit("_"), start.cast("string"), F.lit("_"),
                    end.cast("string"), F.lit("_weekly_report"))


def is_sha256(col: Column) -> Column:
    return F.coalesce(col.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def zoned_timestamp(col: Column) -> Column:
    """ISO-8601 date and time with a zone, else null."""
    text = strip(col)
    shape = (r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?"
             r"(Z|[+-]\d{2}:?\d{2})\z")
    full = F.regexp_replace(text, r"\A(.{13})(Z|[+-])", "$1:00$2")
    full = F.regexp_replace(full, r"\A(.{16})(Z|[+-])", "$1:00$2")
    full = F.regexp_replace(full, r"([+-]\d{2})(\d{2})\z", "$1:$2")
    return F.when(text.rlike(shape), full.try_cast("timestamp"))
