"""Tables with one row per response: repeats, ground truth, model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.options import NUM_REPEATS


def expand_repeats(samples: DataFrame, num_repeats: int = NUM_REPEATS) -> DataFrame:
    """Every sample ``num_repeats`` times, told apart by ``repeat_id`` from 0."""
    if num_repeats < 1:
        return samples.withColumn("repeat_id", F.lit(0)).limit(0)
    repeats = F.sequence(F.lit(0), F.lit(num_repeats - 1))
    return samples.withColumn("repeat_id", F.explode(repeats))


def attach_ground_truth(
    rollouts: DataFrame, samples: DataFrame, columns: list[str], key: str = "sample_id"
) -> DataFrame:
    """Add sample columns, such as the true answer, to each sample's rollouts.

    Rollouts whose sample is missing stay, with NULL; the evaluation counts a
    missing true answer as an error.
    """
    return rollouts.join(samples.select(key, *columns), key, "left")


def attach_model_outputs(
    rollouts: DataFrame,
    outputs: DataFrame,
    columns: list[str],
    keys: tuple[str, ...] = ("sample_id", "repeat_id"),
) -> DataFrame:
    """Add model outputs, such as logits; rollouts without any keep NULL."""
    return rollouts.join(outputs.select(*keys, *columns), list(keys), "left")


# Fixed value: the probability of each option when none could be computed.
UNIFORM_PROBABILITY = 0.333


def option_probabilities(
    logits: dict[str, Column], response: Column | None = None
) -> dict[str, Column]:
    """Softmax over the options' logits, by option.

    A missing logit gives ``UNIFORM_PROBABILITY`` to all. With a ``response``,
    the probabilities are NULL when it never opens an answer tag.
    """
    top = F.greatest(*logits.values())
    weights = {option: F.exp(logit - top) for option, logit in logits.items()}
    total = sum(weights.values(), F.lit(0.0))
    missing = F.lit(False)
    for logit in logits.values():
        missing = missing | logit.isNull()
    probabilities = {}
    for option, weight in weights.items():
        value = F.when(missing, UNIFORM_PROBABILITY).otherwise(weight / total)
        if response is not None:
            value = F.when(F.contains(response, F.lit("<answer>")), value)
        probabilities[option] = value
    return probabilities
