"""String expressions with Python's string semantics.

Everything here is a plain ``Column`` expression: no UDF, no shuffle, usable in
batch and streaming plans alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() and str.split() treat as
# whitespace. Spark's trim() knows only the space, and \s in a Java regex knows
# only six of them.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    "           "
    "    　"
)

# The same set as the inside of a regex character class.
WHITESPACE_RANGES = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{WHITESPACE_RANGES}]"
NON_SPACE = f"[^{WHITESPACE_RANGES}]"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def first_word(text: Column) -> Column:
    """The first whitespace-delimited word, ``''`` when there is none."""
    return F.regexp_extract(strip(text), f"^({NON_SPACE}+)", 1)


def after_last(text: Column, tag: str) -> Column:
    """What follows the last ``tag``; the whole text when ``tag`` is absent."""
    return F.substring_index(text, tag, -1)


def before_first(text: Column, tag: str) -> Column:
    """What precedes the first ``tag``; the whole text when ``tag`` is absent."""
    return F.substring_index(text, tag, 1)


def second_piece(text: Column, tag: str) -> Column:
    """What lies between the first ``tag`` and the next one (or the end).

    Only meaningful when ``tag`` occurs.
    """
    return after_last(F.substring_index(text, tag, 2), tag)


def occurrences(text: Column, token: str) -> Column:
    """How often ``token`` occurs, counted left to right without overlap."""
    # Sizes in bytes are known without reading the text.
    rest = F.replace(text, F.lit(token), F.lit(""))
    removed = F.octet_length(text) - F.octet_length(rest)
    return (removed / F.lit(len(token.encode()))).cast("int")


def _overlaps_itself(token: str) -> bool:
    return any(token.startswith(token[i:]) for i in range(1, len(token)))


def after_last_token(text: Column, token: str) -> Column:
    """``after_last`` for any token, with occurrences counted from the left."""
    if _overlaps_itself(token):
        return F.split_part(text, F.lit(token), F.lit(-1))
    return after_last(text, token)


def occurs_once(text: Column, token: str) -> Column:
    """True when ``token`` occurs exactly once."""
    if _overlaps_itself(token):
        return occurrences(text, token) == 1
    # Then the text is what is before it, the token, and what is after it. Sizes
    # in bytes are known without reading the text.
    around = F.octet_length(before_first(text, token)) + F.octet_length(after_last(text, token))
    whole = around + len(token.encode()) == F.octet_length(text)
    return F.contains(text, F.lit(token)) & whole


def has_pair(text: Column, tag: str) -> Column:
    """True when both ``<tag>`` and ``</tag>`` occur, in any order."""
    return F.contains(text, F.lit(f"<{tag}>")) & F.contains(text, F.lit(f"</{tag}>"))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """True when any phrase occurs in ``text`` (which is already lower case)."""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase.lower()))
    return hit


def quote(literal: str) -> str:
    """A regex that matches ``literal`` and nothing else."""
    return re.escape(literal)


def _float_text(number: Column) -> Column:
    """A double as Python writes it: exponents only below 1e-4 and from 1e16 on."""
    text = number.cast("string")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    # Spark writes d.ddd and E, the exponent, below 1e-3 and from 1e7 on.
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), "^-", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.replace(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("."), F.lit(""))
    fraction = F.substr(digits, F.lit(2))
    zeros = F.repeat(F.lit("0"), exponent + 1 - F.length(digits))
    large = F.when(F.length(digits) <= exponent + 1, F.concat(digits, zeros, F.lit(".0"))).otherwise(
        F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
    )
    written = F.concat(
        F.substr(digits, F.lit(1), F.lit(1)),
        F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    # Two digits at least; lpad would cut a third.
    written = F.when(F.abs(exponent) < 100, written).otherwise(
        F.concat(F.regexp_replace(written, r"e([+-])\d+$", "e$1"), F.abs(exponent).cast("string"))
    )
    shifted = (
        F.when(exponent == -4, F.concat(F.lit("0.000"), digits))
        .when((exponent > 0) & (exponent < 16), large)
        .otherwise(written)
    )
    return (
        F.when(F.isnan(number), "nan")
        .when(F.abs(number) == float("inf"), F.concat(sign, F.lit("inf")))
        .when(F.contains(text, F.lit("E")), F.concat(sign, shifted))
        .otherwise(text)
    )


def as_text(column: Column, data_type: T.DataType) -> Column:
    """A value as it reads inside a formatted Python string (NULL is ``None``).

    ``ValueError`` for arrays, maps and structs.
    """
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"a column of type {data_type.simpleString()} can't be part of a text")
    if isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType):
        return F.coalesce(_float_text(column.cast("double")), F.lit("None"))
    if isinstance(data_type, T.BooleanType):
        text = F.when(column, "True").otherwise("False")
        return F.when(column.isNull(), "None").otherwise(text)
    return F.coalesce(column.cast("string"), F.lit("None"))


def is_filled(column: Column, data_type: T.DataType) -> Column:
    """True when a value counts as present: not NULL, not empty, not zero."""
    if isinstance(data_type, T.StringType):
        present = column != ""
    elif isinstance(data_type, T.BooleanType):
        present = column
    elif isinstance(data_type, T.NumericType):
        present = column != 0
    else:
        present = column.isNotNull()
    return F.coalesce(present, F.lit(False))
