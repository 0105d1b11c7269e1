"""Language identification by a vote of function words.

A stand-in for a trained language identifier that needs no model: each language
gets one point for each of its most frequent words that occurs and the highest score
wins. Attach a detector's output as a column when more is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequent function words by language code.
FUNCTION_WORDS = {
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht", "sich", "auf"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "this", "are", "by"],
    "es": ["el", "los", "las", "del", "y", "en", "que", "un", "una", "por", "con", "para", "es", "se"],
    "fr": ["le", "la", "les", "des", "et", "du", "un", "une", "dans", "est", "pour", "qui", "sur", "avec"],
}

# What an undecided text counts as.
DEFAULT_LANGUAGE = "en"


def detect_language(text: Column) -> Column:
    """Code of the language with the most function words, ties by code."""

    def lexicon(*codes: str) -> Column:
        return F.array(*[F.lit(word) for code in codes for word in FUNCTION_WORDS[code]])

    codes = sorted(FUNCTION_WORDS)
    words = F.split(F.lower(text), r"[^\p{L}]+")
    # All function words first: the votes then compare short arrays only.
    known = F.array_intersect(words, F.array_distinct(lexicon(*codes)))
    votes = [
        F.struct(
            F.size(F.array_intersect(known, lexicon(code))).alias("n"),
            F.lit(-rank).alias("rank"),
            F.lit(code).alias("code"),
        )
        for rank, code in enumerate(codes)
    ]
    undecided = F.struct(
        F.lit(0).alias("n"), F.lit(1).alias("rank"), F.lit(DEFAULT_LANGUAGE).alias("code")
    )
    return F.greatest(undecided, *votes)["code"]
