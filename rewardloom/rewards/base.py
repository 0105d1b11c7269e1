"""What a reward is and which columns it can read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions import parse
from rewardloom.functions.text import has_pair, strip

PREFIX = "_rollout_"


@dataclass(frozen=True)
class Inputs:
    """Columns available to a reward: the rollout and what was parsed from it.

    The parsed columns are computed once, in a projection of their own, and
    shared by all rewards; those that no reward reads are pruned by Catalyst.
    """

    completion: Column
    answers: Column
    answer_only: Column

    def parsed(self) -> dict[str, Column]:
        lowered = F.lower(self.completion)
        return {
            "has_answer": has_pair(self.completion, "answer"),
            "has_confidence": has_pair(self.completion, "confidence"),
            "answer": parse.last_tagged(lowered, "answer"),
            "reasoning": parse.last_tagged(lowered, "reasoning"),
            "lettered": parse.lettered_answer(self.completion),
            "confidence": parse.strict_confidence(self.completion),
            "truth": F.lower(strip(self.answers)),
        }

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return F.col(PREFIX + name)

    @property
    def is_correct(self) -> Column:
        return self.answer == self.truth

    @property
    def percent(self) -> Column:
        # Thresholds see the confidence after its trip through 0..1: 57 comes
        # back as 56.99999999999999.
        return self.confidence * 100.0

    def predicts(self, letter: str) -> Column:
        return F.upper(self.answer) == letter.upper().strip()

    def truth_is(self, letter: str) -> Column:
        return F.upper(self.truth) == letter.upper().strip()


@dataclass(frozen=True)
class Reward:
    """A scorer: a column expression over one row.

    ``value`` builds the reward. With ``stage`` set, that expression is computed
    in the parsing projection first and handed to ``value``; it holds what the
    reward needs several times, such as the parts of a matched pattern.
    ``reads`` names the inputs besides the completion; the reward is NULL when
    one of them is NULL.
    """

    value: Callable[..., Column]
    stage: Callable[[Inputs], Column] | None = None
    reads: tuple[str, ...] = ()
    extra_columns: tuple[str, ...] = ()


REWARDS: dict[str, Callable[..., Reward]] = {}


def register(name: str):
    """Make a reward factory available to configurations under ``name``."""

    def add(factory: Callable[..., Reward]) -> Callable[..., Reward]:
        REWARDS[name] = factory
        return factory

    return add


def first_match(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first true condition, NULL when none is."""
    return F.coalesce(*[F.when(condition, value) for condition, value in cases])
