"""Training tables for each training method."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from rewardloom.operators.few_shot import few_shot_prompts
from rewardloom.operators.prepare import keep_filled, require_columns
from rewardloom.operators.responses import ChatTemplate, preference_pairs, training_texts
from rewardloom.operators.rollouts import expand_repeats
from rewardloom.options import Options

# The training methods.
IN_CONTEXT_LEARNING = "in_context_learning"
SFT = "sft"
DPO = "dpo"
SFT_DPO = "sft_dpo"


def sft_table(
    train: DataFrame,
    options: Options,
    template: ChatTemplate,
    separate: DataFrame | None = None,
    keep: list[str] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Training texts of the rows that have a training column.

    A ``separate`` table for supervised training is used whole instead.
    """
    dataset = options.dataset
    if not dataset.sft_column:
        raise ValueError("supervised training needs sft_column to be configured")
    if separate is not None:
        return training_texts(separate, dataset, template, keep)
    require_columns(train, [dataset.sft_column], "supervised training")
    usable = keep_filled(train, dataset.sft_column, observation=observation)
    return training_texts(usable, dataset, template, keep)


def dpo_table(
    train: DataFrame,
    options: Options,
    keep: list[str] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Preference pairs of the rows that have both comments."""
    dataset = options.dataset
    if not dataset.sft_column:
        raise ValueError("preference training needs sft_column to be configured")
    needed = [dataset.sft_column, dataset.dpo_comment_column]
    require_columns(train, needed, "preference training")
    return preference_pairs(keep_filled(train, *needed, observation=observation), dataset, keep)


def few_shot_table(train: DataFrame, test: DataFrame, options: Options) -> DataFrame:
    """Few-shot prompts of the test rows, one row per generation to run."""
    dataset, baseline = options.dataset, options.baseline
    prompts = few_shot_prompts(
        train,
        test,
        topic=dataset.topic_column,
        id_column=dataset.id_column,
        cap=baseline.max_context_examples,
        seed=options.random_seed,
    )
    return expand_repeats(prompts, baseline.num_repeats)


def build_training_tables(
    train: DataFrame,
    test: DataFrame,
    options: Options,
    method: str = DPO,
    template: ChatTemplate = ChatTemplate(),
    separate: DataFrame | None = None,
    keep: list[str] | None = None,
) -> dict[str, DataFrame]:
    """The tables a method trains on or prompts with, by kind.

    ``prompts`` for in-context learning, ``texts`` for supervised training,
    ``pairs`` for preference training.
    """
    if method == IN_CONTEXT_LEARNING:
        return {"prompts": few_shot_table(train, test, options)}
    if method == SFT:
        return {"texts": sft_table(train, options, template, separate, keep)}
    if method == DPO:
        return {"pairs": dpo_table(train, options, keep)}
    if method == SFT_DPO:
        return {
            "texts": sft_table(train, options, template, separate, keep),
            "pairs": dpo_table(train, options, keep),
        }
    raise ValueError(f"unknown method {method!r}")
