"""Rewards for giving the right or an allowed answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.text import strip
from rewardloom.rewards.base import Reward, first_match, register

# Only the start of an answer is searched for an option letter.
ANSWER_AREA = 5


def _without(text: Column, *words: str) -> Column:
    for word in words:
        text = F.replace(text, F.lit(word), F.lit(""))
    return strip(text)


@register("right_answer_in_completion")
def right_answer_in_completion() -> Reward:
    """1.0 when the right letter is in the answer's start, -0.5 for no letter."""

    def stage(r):
        return _without(_without(r.parsed()["answer"], "rather"), "yes", "no")

    def value(r, answer):
        area = F.substring(answer, 1, ANSWER_AREA)
        right = F.contains(area, F.lower(r.answers))
        return F.when(answer == "", -0.5).when(right, 1.0).otherwise(0.0)

    return Reward(value, stage, reads=("answers",))


@register("answer_in_completion")
def answer_in_completion(options: list[str]) -> Reward:
    """0.5 when a tagged answer is exactly one of the options."""
    allowed = [option.lower() for option in options]

    def value(r):
        known = _without(r.answer, "rather").isin(*allowed)
        return F.when(r.has_answer & known, 0.5).otherwise(0.0)

    return Reward(value)


@register("answer_distance")
def answer_distance(options: list[str], values: list[float]) -> Reward:
    """2.0 for the right option, less the farther its value is from the truth.

    The first option found in the answer's start is the prediction; 0.0 when
    there is none. A true answer outside the options gives NULL.
    """
    scale = [(option.lower(), float(v)) for option, v in zip(options, values)]

    def value(r):
        area = strip(F.substring(_without(r.answer, "rather"), 1, ANSWER_AREA))
        predicted = first_match([(F.contains(area, F.lit(o)), F.lit(v)) for o, v in scale])
        actual = first_match([(F.lower(r.answers) == o, F.lit(v)) for o, v in scale])
        return F.when(predicted.isNull(), 0.0).otherwise(2.0 - 2.0 * F.abs(predicted - actual))

    return Reward(value, reads=("answers",))
