"""Pull answers, reasoning and confidence out of a response.

Answers are read in three ways because callers disagree on which tag counts:
rewards read the *last* ``<answer>``, the evaluation reads the *first* one, and
the few-shot evaluation reads the first word of an untagged reply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.text import (
    after_last,
    before_first,
    has_pair,
    quote,
    second_piece,
    strip,
)

OPTION_LETTERS = ("A", "B", "C")

# An untagged reply longer than this is not taken as an answer.
LONGEST_BARE_ANSWER = 200


def last_tagged(text: Column, tag: str) -> Column:
    """Content of the last ``tag``; the whole text when there is no tag."""
    return strip(before_first(after_last(text, f"<{tag}>"), f"</{tag}>"))


def first_tagged(text: Column, tag: str) -> Column:
    """Content of the first ``tag``; NULL unless both tags occur."""
    content = before_first(second_piece(text, f"<{tag}>"), f"</{tag}>")
    return F.when(has_pair(text, tag), strip(content))


def lettered_answer(text: Column) -> Column:
    """Last tagged answer, cut down to its letter when it starts with an option.

    The case of other answers is kept, and any word starting with an option
    letter counts: ``Because`` is read as ``B``.
    """
    answer = last_tagged(text, "answer")
    initial = F.upper(F.substring(answer, 1, 1))
    return F.when(initial.isin(*OPTION_LETTERS), initial).otherwise(answer)


def strict_confidence(text: Column) -> Column:
    """Confidence in 0..1 from one to three digits up to 100, else NULL."""
    raw = first_tagged(text, "confidence")
    percent = F.when(raw.rlike("^[0-9]{1,3}$"), raw.try_cast("int"))
    return F.when(percent <= 100, percent.cast("double") / 100.0)


def lenient_confidence(text: Column) -> Column:
    """First number in the confidence tag; values above 1 are read as percent."""
    digits = F.regexp_extract(first_tagged(text, "confidence"), r"([0-9]+(?:\.[0-9]+)?)", 1)
    number = digits.try_cast("double")
    return number / F.when(number > 1, 100.0).otherwise(1.0)


def evaluated_answer(text: Column) -> Column:
    """First tagged answer, or the stripped reply when the tags are missing."""
    return F.coalesce(first_tagged(text, "answer"), strip(text))


def is_parsed(text: Column) -> Column:
    """False for an untagged reply that is blank or too long to be an answer."""
    bare = strip(text)
    usable = (bare != "") & (F.length(bare) <= LONGEST_BARE_ANSWER)
    return has_pair(text, "answer") | usable


def same_answer(left: Column, right: Column) -> Column:
    """Equality of two answers, ignoring case and outer whitespace."""
    return F.lower(strip(left)) == F.lower(strip(right))


def answer_probe(text: Column) -> Column:
    """The reply up to and including its first ``<answer>``; NULL without one."""
    position = F.instr(text, "<answer>")
    return F.when(position > 0, F.left(text, position + F.lit(len("<answer>") - 1)))


def split_in_order(text: Column, delimiters: list[str]) -> tuple[Column, list[Column]]:
    """Cut ``text`` at the first match of each delimiter regex, one after another.

    Returns whether every delimiter was found, and the pieces between them.
    For delimiters d0..dn this finds exactly what a search for
    ``d0(.*?)d1(.*?)...dn`` with a dot that spans lines finds, since taking each
    delimiter at its first occurrence leaves the most text for the others. It
    reads the text once and never backtracks, whereas the single pattern can
    take time quadratic in the number of repeated tags.
    """
    rest = F.get(F.split(text, delimiters[0], 2), 1)
    pieces = []
    for delimiter in delimiters[1:]:
        cut = F.split(rest, delimiter, 2)
        pieces.append(F.get(cut, 0))
        rest = F.get(cut, 1)
    return rest.isNotNull(), pieces


def opening(tag: str) -> str:
    return quote(f"<{tag}>")


def closing(tag: str) -> str:
    return quote(f"</{tag}>")
