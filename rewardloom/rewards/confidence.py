"""Rewards for stating a confidence that matches how often one is right.

Confidences are compared with thresholds in percent. The neutral answer is an
abstention: it is judged by rules of its own when confidence is low.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.rewards.base import Inputs, Reward, register

# Keeps the logarithm finite at confidences 0 and 1.
LOG_MARGIN = 1e-8

# For a confidence that is there but not a number from 0 to 100.
MALFORMED = -1.0


def _scored(r: Inputs, value: Column) -> Column:
    """``value`` where answer and confidence are tagged and the latter is valid."""
    return (
        F.when(~(r.has_answer & r.has_confidence), 0.0)
        .when(r.confidence.isNull(), MALFORMED)
        .otherwise(value)
    )


def _wrong_neutral(r: Inputs, neutral: str) -> Column:
    return r.predicts(neutral) & ~r.is_correct


def _outcome(r: Inputs) -> Column:
    return F.when(r.is_correct, 1.0).otherwise(0.0)


def _square_error(r: Inputs) -> Column:
    error = r.confidence - _outcome(r)
    return error * error


def _unless_unsure_neutral(r: Inputs, neutral: str, threshold: float, value: Column) -> Column:
    """Zero for a right neutral answer of low confidence, else ``value``."""
    unsure = r.is_correct & r.truth_is(neutral) & r.predicts(neutral) & (r.percent < threshold)
    return F.when(unsure, 0.0).otherwise(value)


@register("confidence_aware_answer")
def confidence_aware_answer(
    confidence_threshold: float = 70,
    neutral_threshold: float = 50,
    neutral_answer: str = "C",
    high_confidence_correct_reward: float = 1.0,
    high_confidence_wrong_penalty: float = -0.5,
    high_confidence_neutral_penalty: float = -0.3,
    low_confidence_correct_reward: float = 0.5,
    low_confidence_wrong_reward: float = 0.2,
    low_confidence_neutral_reward: float = 0.4,
    no_confidence_penalty: float = 0.1,
) -> Reward:
    """Full reward for being right and sure, lenient when unsure.

    Without a confidence a right answer loses ``no_confidence_penalty`` and a
    wrong one *gains* it; that sign is part of the definition.
    """

    def value(r):
        unstated = F.when(
            r.is_correct, high_confidence_correct_reward - no_confidence_penalty
        ).otherwise(F.lit(float(no_confidence_penalty)))
        sure = (
            F.when(r.is_correct, float(high_confidence_correct_reward))
            .when(r.predicts(neutral_answer), float(high_confidence_neutral_penalty))
            .otherwise(float(high_confidence_wrong_penalty))
        )
        very_unsure = r.predicts(neutral_answer) & (r.percent < neutral_threshold)
        unsure = (
            F.when(r.is_correct, float(low_confidence_correct_reward))
            .when(very_unsure, float(low_confidence_neutral_reward))
            .otherwise(float(low_confidence_wrong_reward))
        )
        return (
            F.when(~r.has_answer, 0.0)
            .when(r.confidence.isNull(), unstated)
            .when(r.percent >= confidence_threshold, sure)
            .otherwise(unsure)
        )

    return Reward(value, reads=("answers",))


@register("brier_calibration")
def brier_calibration(
    calibration_weight: float = 0.5,
    sharpness_weight: float = 0.0,
    neutral_answer: str = "C",
    neutral_confidence_threshold: float = 50,
) -> Reward:
    """Accuracy mixed with the negative Brier score, plus a bonus for sharpness."""

    def value(r):
        calibration = _unless_unsure_neutral(
            r, neutral_answer, neutral_confidence_threshold, -_square_error(r)
        )
        return _scored(
            r,
            _outcome(r) * (1 - calibration_weight)
            + calibration * calibration_weight
            + F.abs(r.confidence - 0.5) * sharpness_weight,
        )

    return Reward(value, reads=("answers",))


@register("loglikelihood_calibration")
def loglikelihood_calibration(
    calibration_weight: float = 0.5,
    neutral_answer: str = "C",
    neutral_confidence_threshold: float = 50,
) -> Reward:
    """Accuracy mixed with the log-likelihood of the outcome."""

    def value(r):
        sure = F.greatest(F.lit(LOG_MARGIN), F.least(F.lit(1 - LOG_MARGIN), r.confidence))
        likelihood = F.when(r.is_correct, F.ln(sure)).otherwise(F.ln(1 - sure))
        calibration = _unless_unsure_neutral(
            r, neutral_answer, neutral_confidence_threshold, likelihood
        )
        return _scored(
            r, _outcome(r) * (1 - calibration_weight) + calibration * calibration_weight
        )

    return Reward(value, reads=("answers",))


@register("focal_confidence")
def focal_confidence(
    epsilon: float = 0.1,
    neutral_answer: str = "C",
    neutral_confidence_threshold: float = 50,
) -> Reward:
    """Negative Brier score, weighted by the distance from an even guess."""

    def value(r):
        weight = F.abs(r.confidence - 0.5) + epsilon
        return _scored(
            r,
            _unless_unsure_neutral(
                r, neutral_answer, neutral_confidence_threshold, -weight * _square_error(r)
            ),
        )

    return Reward(value, reads=("answers",))


@register("high_confidence_accuracy")
def high_confidence_accuracy(
    confidence_threshold: float = 70,
    neutral_answer: str = "C",
    correct_reward: float = 1.0,
    wrong_penalty: float = -0.5,
) -> Reward:
    """Reward or penalty for sure answers; wrong neutral ones count nothing."""

    def value(r):
        sure = (
            F.when(r.is_correct, float(correct_reward))
            .when(r.predicts(neutral_answer), 0.0)
            .otherwise(float(wrong_penalty))
        )
        return _scored(r, F.when(r.percent >= confidence_threshold, sure).otherwise(0.0))

    return Reward(value, reads=("answers",))


@register("low_confidence_humility")
def low_confidence_humility(
    confidence_threshold: float = 70,
    neutral_threshold: float = 50,
    neutral_answer: str = "C",
    correct_reward: float = 0.5,
    wrong_reward: float = 0.2,
) -> Reward:
    """Credit for unsure answers, except very unsure and wrong neutral ones."""

    def value(r):
        abstained = (r.percent < neutral_threshold) & _wrong_neutral(r, neutral_answer)
        unsure = (
            F.when(abstained, 0.0)
            .when(r.is_correct, float(correct_reward))
            .otherwise(float(wrong_reward))
        )
        return _scored(r, F.when(r.percent < confidence_threshold, unsure).otherwise(0.0))

    return Reward(value, reads=("answers",))


@register("neutral_when_uncertain")
def neutral_when_uncertain(
    neutral_threshold: float = 50, neutral_answer: str = "C", bonus_reward: float = 0.4
) -> Reward:
    """Bonus for a wrong neutral answer of low confidence."""

    def value(r):
        abstained = (r.percent < neutral_threshold) & _wrong_neutral(r, neutral_answer)
        return _scored(r, F.when(abstained, float(bonus_reward)).otherwise(0.0))

    return Reward(value, reads=("answers",))


@register("high_confidence_neutral_penalty")
def high_confidence_neutral_penalty(
    confidence_threshold: float = 70, neutral_answer: str = "C", penalty: float = -0.3
) -> Reward:
    """Penalty for a wrong neutral answer of high confidence."""

    def value(r):
        evaded = (r.percent >= confidence_threshold) & _wrong_neutral(r, neutral_answer)
        return _scored(r, F.when(evaded, float(penalty)).otherwise(0.0))

    return Reward(value, reads=("answers",))


@register("confidence_provision")
def confidence_provision(penalty: float = -0.1) -> Reward:
    """Penalty for stating no valid confidence, halved when the answer is right."""

    def value(r):
        unstated = F.when(r.is_correct, penalty * 0.5).otherwise(float(penalty))
        return F.when(r.has_answer & r.confidence.isNull(), unstated).otherwise(0.0)

    return Reward(value, reads=("answers",))


@register("neutral_ground_truth")
def neutral_ground_truth(
    neutral_answer: str = "C", confidence_threshold: float = 50, reward: float = 0.5
) -> Reward:
    """Reward for an unsure neutral answer where neutral is the truth."""

    def value(r):
        humble = (
            r.truth_is(neutral_answer)
            & r.predicts(neutral_answer)
            & (r.percent < confidence_threshold)
        )
        return _scored(r, F.when(humble, float(reward)).otherwise(0.0))

    return Reward(value, reads=("answers",))


@register("simple_confidence")
def simple_confidence(
    neutral_answer: str = "C", no_confidence_penalty: float = -0.1, allow_neutral: bool = True
) -> Reward:
    """Plus the confidence when right, minus the confidence when wrong.

    A neutral answer scores 0, or as a wrong one when ``allow_neutral`` is off.
    """

    def value(r):
        neutral = F.upper(r.lettered) == neutral_answer.upper().strip()
        right = (F.lower(r.lettered) == r.truth) & ~neutral
        abstains = neutral if allow_neutral else F.lit(False)
        return (
            F.when(~r.has_answer | abstains, 0.0)
            .when(r.confidence.isNull(), float(no_confidence_penalty))
            .when(right, r.confidence)
            .otherwise(-r.confidence)
        )

    return Reward(value, reads=("answers",))
