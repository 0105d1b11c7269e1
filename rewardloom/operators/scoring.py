"""Score rollouts with a list of rewards and combine the scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.rewards import REWARDS, Inputs, Reward
from rewardloom.rewards.base import PREFIX

# Families of format rewards, by registry name.
TRADITIONAL_FORMATS = ("hard_format", "soft_format", "xml_format")
MODULAR_FORMATS = ("three_step_format", "modular_step_format")
MULTISTEP_FORMATS = ("multistep_format", "multistep_xml_format")
TWO_STAGE_FORMAT = "two_stage_format"


def reward_name(spec: str | Mapping[str, Any]) -> str:
    return spec if isinstance(spec, str) else spec["name"]


def make_reward(spec: str | Mapping[str, Any]) -> Reward:
    """Build the reward a specification names: a name, or name and args."""
    name = reward_name(spec)
    if name not in REWARDS:
        raise ValueError(f"unknown reward {name!r}; known: {', '.join(sorted(REWARDS))}")
    args = {} if isinstance(spec, str) else dict(spec.get("args") or {})
    return REWARDS[name](**args)


def check_formats(specs: Iterable[str | Mapping[str, Any]]) -> None:
    """Raise ``ValueError`` for format rewards that contradict each other."""
    names = [reward_name(spec) for spec in specs]
    traditional = [n for n in names if n in TRADITIONAL_FORMATS]
    modular = [n for n in names if n in MODULAR_FORMATS]
    multistep = [n for n in names if n in MULTISTEP_FORMATS]
    if modular and (traditional or multistep):
        others = ", ".join(traditional + multistep)
        raise ValueError(f"{modular[0]} cannot be combined with {others}")
    if len(modular) > 1:
        raise ValueError("only one modular step format can be used")
    if TWO_STAGE_FORMAT in names and (traditional or modular or multistep):
        raise ValueError(f"{TWO_STAGE_FORMAT} cannot be combined with other format rewards")


def reward_columns(specs: Iterable[str | Mapping[str, Any]]) -> list[str]:
    """Output column of each specification; repeated names get a number."""
    seen: Counter[str] = Counter()
    columns = []
    for spec in specs:
        name = reward_name(spec)
        seen[name] += 1
        columns.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return columns


def score(
    rollouts: DataFrame,
    specs: list[str | Mapping[str, Any]],
    *,
    completion: str = "completion",
    answers: str = "answers",
    answer_only: str = "answer_only",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add one double column per reward to a table of rollouts.

    Two projections and nothing else: what the rewards share is parsed in the
    first, the rewards are computed in the second. No shuffle and no Python
    worker, so this scales with the scan, and it works on streams. ``keep``
    names the input columns to carry over (default: all); dropping the response
    text there keeps the scores narrow.

    A reward is NULL when the completion, or another column it reads, is NULL.
    """
    has_flag = answer_only in rollouts.columns
    inputs = Inputs(
        completion=F.col(completion),
        answers=F.col(answers) if answers in rollouts.columns else F.lit(None).cast("string"),
        answer_only=F.col(answer_only) if has_flag else F.lit(False),
    )
    rewards = [make_reward(spec) for spec in specs]
    names = reward_columns(specs)
    for name, reward in zip(names, rewards):
        missing = [c for c in reward.extra_columns if c not in rollouts.columns]
        if "answers" in reward.reads and answers not in rollouts.columns:
            missing.append(answers)
        if missing:
            raise ValueError(f"{name} needs column(s) {', '.join(missing)}")

    shared = {PREFIX + name: column for name, column in inputs.parsed().items()}
    staged = {
        f"{PREFIX}for_{name}": reward.stage(inputs)
        for name, reward in zip(names, rewards)
        if reward.stage
    }
    parsed = rollouts.withColumns({**shared, **staged})

    scored = []
    for name, reward in zip(names, rewards):
        extra = [F.col(f"{PREFIX}for_{name}")] if reward.stage else []
        present = inputs.completion.isNotNull()
        for column in reward.reads:
            present = present & getattr(inputs, column).isNotNull()
        value = reward.value(inputs, *extra).cast("double")
        # Adding NULL makes a reward NULL without making it conditional:
        # subexpressions are shared only where they are always evaluated.
        scored.append((value + F.when(present, 0.0)).alias(name))
    return parsed.select(*(rollouts.columns if keep is None else keep), *scored)


def total_reward(columns: list[str], weights: list[float] | None = None) -> Column:
    """Weighted sum of reward columns; a NULL reward adds nothing."""
    weights = [1.0] * len(columns) if weights is None else weights
    if len(weights) != len(columns):
        raise ValueError("one weight per reward column is needed")
    total = F.lit(0.0)
    for column, weight in zip(columns, weights):
        total = total + F.coalesce(F.col(column), F.lit(0.0)) * float(weight)
    return total
