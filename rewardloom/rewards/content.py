"""Rewards for what the reasoning says and the language it is in."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardloom.functions.language import FUNCTION_WORDS, detect_language
from rewardloom.functions.text import contains_any
from rewardloom.rewards.base import Reward, register

# Phrases that show the user's profile was used. The longer forms
# ("based on the ...", "from the ...", "using the ...", "according to the ...",
# "the ...") each contain one of these, so finding these finds all of them.
PROFILE_PHRASES = [
    "user's profile",
    "user's past",
    "user's history",
    "user's data",
    "user's preferences",
]


@register("profile_used_reward")
def profile_used_reward(profile_dims: list[str]) -> Reward:
    """1.0 for naming a profile dimension, 0.5 for referring to the profile."""

    def value(r):
        named = F.when(contains_any(r.reasoning, profile_dims), 1.0).otherwise(0.0)
        referred = F.when(contains_any(r.reasoning, PROFILE_PHRASES), 0.5).otherwise(0.0)
        return named + referred

    return Reward(value)


@register("entailment")
def entailment(
    model_name_or_path: str | None = None,
    pos_options: list[str] | None = None,
    neg_options: list[str] | None = None,
    scores_column: str = "class_scores",
) -> Reward:
    """Twice the classifier's score for the label that the true answer calls for.

    The classifier runs elsewhere; its output is read from ``scores_column``, an
    ``array<struct<label, score>>``. ``model_name_or_path`` and ``neg_options``
    are accepted so that configurations carry over; neither affects the result.
    """
    positive = ["A", "B"] if pos_options is None else pos_options

    def value(r):
        scores = F.col(scores_column)
        wanted = F.when(r.answers.isin(*positive), "LABEL_1").otherwise("LABEL_0")
        labelled = F.get(F.filter(scores, lambda s: s["label"] == wanted), 0)
        return F.coalesce(labelled, F.get(scores, 0))["score"] * 2.0

    return Reward(value, reads=("answers",), extra_columns=(scores_column,))


@register("language")
def language(language: str, detected_column: str | None = None) -> Reward:
    """1.0 when the response is in the wanted language.

    Reads a detector's result from ``detected_column`` when one is given, else
    decides by function words; a language without such words is then an error.
    """
    if not detected_column and language not in FUNCTION_WORDS:
        raise ValueError(f"no function words for {language!r}, only for {', '.join(FUNCTION_WORDS)}; pass detected_column")

    def detected(r):
        return F.col(detected_column) if detected_column else detect_language(r.completion)

    def value(r, found):
        return F.when(found == language, 1.0).otherwise(0.0)

    extra = (detected_column,) if detected_column else ()
    return Reward(value, detected, extra_columns=extra)
