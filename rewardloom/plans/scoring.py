"""Score rollouts as a trainer does: rewards, their sum, their group advantage."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from rewardloom.operators.advantage import group_advantage
from rewardloom.operators.scoring import check_formats, reward_columns, score, total_reward
from rewardloom.scratch import materialize

KEYS = ["sample_id", "repeat_id"]


def score_rollouts(
    rollouts: DataFrame,
    specs: list[Any],
    weights: list[float] | None = None,
    keep: list[str] | None = None,
    **columns: str,
) -> DataFrame:
    """Keys, one column per reward and ``reward_total``, for a checked reward list."""
    if not specs:
        raise ValueError("no reward functions are configured")
    check_formats(specs)
    scores = score(rollouts, specs, keep=KEYS if keep is None else keep, **columns)
    return scores.withColumn("reward_total", total_reward(reward_columns(specs), weights))


def advantages(
    rollouts: DataFrame,
    specs: list[Any],
    weights: list[float] | None = None,
    epsilon: float = 1e-4,
    **columns: str,
) -> DataFrame:
    """Scores with the advantage of each completion within its prompt's group.

    The narrow table of scores is written in between: texts are parsed once and
    only scores are shuffled.
    """
    scores = score_rollouts(rollouts, specs, weights, **columns)
    return group_advantage(materialize(scores, "scores"), epsilon=epsilon)
