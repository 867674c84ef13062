"""Splitting fields that pack several values, as one SQL expression without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that quote, that bracket, and that separate values outside quotes.
QUOTES = "\"'`\u00b4\u2018\u2019\u201a\u201c\u201d\u201e\u00ab\u00bb"
BRACKETS = r"\[\](){}<>"
DELIMITERS = r"(?U)[\s,;|/&\u3001\uff0c\uff1b\uff5c]+"


def unpack_values(field: Column) -> Column:
    """array<string> of the values in a packed field, in the order written, with repeats.

    The field is split at quote characters. Odd pieces are literals, kept whole unless they open with a bracket
    (then the quotes stand around a whole list); even pieces are split at delimiters, and brackets, dots and colons
    at a value's ends are dropped. The pieces' values are put together in order, in one pass. Whatever holds no digit (words such
    as "and", "nan", "...") is no value. Null, empty and blank fields give an empty array. A quoted list with
    escaped quotes is unwrapped first. An unclosed quote makes a literal of the rest.
    """
    escaped = field.contains('\\"') | field.contains("\\'")
    unwrapped = F.regexp_replace(F.regexp_replace(field, r"(?U)^\s*[\"']|[\"']\s*$", ""), r"\\([\"'])", "$1")
    x = F.when(escaped, unwrapped).otherwise(field)
    pieces = F.split(F.translate(x, QUOTES, '"' * len(QUOTES)), '"')
    marked = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), (i % 2 == 1).alias("literal")))

    def tidy(v: Column) -> Column:
        return F.regexp_replace(v, rf"(?U)^[\s{BRACKETS}.:]+|[\s{BRACKETS}.:]+$", "")

    def values(piece: Column) -> Column:
        whole = piece["literal"] & ~piece["p"].rlike(rf"^\s*[{BRACKETS}]")
        return F.when(whole, F.array(piece["p"])).otherwise(F.split(piece["p"], DELIMITERS))

    found = F.filter(F.transform(F.flatten(F.transform(marked, values)), tidy), lambda v: v.rlike("[0-9]"))
    return F.coalesce(found, F.array().cast("array<string>"))


def explode_packed(df: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """key, pos (from 1), value: a row for each value. Rows without any value give none."""
    return df.select(F.col(key), F.posexplode(unpack_values(F.col(field))).alias("pos", value)).select(
        key, (F.col("pos") + 1).cast("int").alias("pos"), value
    )
