"""Options of a run, as frozen dataclasses.

``Options.from_mapping`` accepts the nested mapping a configuration file holds,
flat or under a ``reasoning`` key; unknown keys are ignored, since such files
also configure models and trainers, which are not run here.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

# Defaults of the evaluation and the few-shot prompts.
NUM_REPEATS = 8
MAX_CONTEXT_EXAMPLES = 80


def _known(cls, values: Mapping[str, Any] | None) -> dict[str, Any]:
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in (values or {}).items() if k in names}


@dataclass(frozen=True)
class TwoStageColumns:
    """Columns of a response that thinks, states a confidence, thinks again."""

    think1_column: str = "think1"
    confidence_column: str = "confidence"
    think2_column: str = "think2"


@dataclass(frozen=True)
class DatasetOptions:
    """Where the questions are and what their columns mean.

    ``format`` is ``parquet`` (a table with a split column) or ``arrow_shards``
    (a folder of Arrow shards per split, whose rows are numbered on reading).
    """

    path: str | None = None
    format: str = "parquet"
    train_split: str = "train"
    test_split: str = "test"
    split_column: str = "split"
    id_column: str = "row_id"
    system_prompt: str = ""
    question_column: str = "question"
    answer_column: str = "answer"
    topic_column: str = "topic"
    sft_column: str | None = None
    dpo_comment_column: str = "dpo_comment"
    reasoning_column: str | None = None
    reasoning_tag_name: str = "reasoning"
    two_stage_reasoning: TwoStageColumns | None = None
    multistep_reasoning_columns: Mapping[str, str] | None = None
    dedup_column: str = "question"
    subset_fraction: float | None = None
    sft_dataset_path: str | None = None
    sft_train_split: str = "train"

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any] | None) -> DatasetOptions:
        known = _known(cls, values)
        stages = known.get("two_stage_reasoning")
        if isinstance(stages, Mapping):
            known["two_stage_reasoning"] = (
                TwoStageColumns(**_known(TwoStageColumns, stages)) if stages else None
            )
        return cls(**known)


@dataclass(frozen=True)
class EvaluationOptions:
    num_repeats: int = NUM_REPEATS


@dataclass(frozen=True)
class BaselineOptions:
    num_repeats: int = NUM_REPEATS
    max_context_examples: int = MAX_CONTEXT_EXAMPLES


@dataclass(frozen=True)
class Options:
    dataset: DatasetOptions = field(default_factory=DatasetOptions)
    evaluation: EvaluationOptions = field(default_factory=EvaluationOptions)
    baseline: BaselineOptions = field(default_factory=BaselineOptions)
    reward_funcs: tuple[Any, ...] = ()
    random_seed: int = 42

    @classmethod
    def from_mapping(cls, config: Mapping[str, Any]) -> Options:
        config = config.get("reasoning", config)
        return cls(
            dataset=DatasetOptions.from_mapping(config.get("dataset")),
            evaluation=EvaluationOptions(**_known(EvaluationOptions, config.get("evaluation"))),
            baseline=BaselineOptions(**_known(BaselineOptions, config.get("baseline"))),
            reward_funcs=tuple((config.get("trainer") or {}).get("reward_funcs") or ()),
            random_seed=config.get("random_seed", 42),
        )

    def with_splits(self, train: str | None = None, test: str | None = None) -> Options:
        """These options with one or both split names replaced."""
        given = {"train_split": train, "test_split": test}
        changes = {k: v for k, v in given.items() if v is not None}
        return replace(self, dataset=replace(self.dataset, **changes))


def merge(config: Mapping[str, Any], overrides: Mapping[str, Any] | None) -> dict[str, Any]:
    """``config`` with ``overrides`` laid over it, section by section."""
    merged = dict(config)
    for key, value in (overrides or {}).items():
        nested = isinstance(value, Mapping) and isinstance(merged.get(key), Mapping)
        merged[key] = merge(merged[key], value) if nested else value
    return merged
