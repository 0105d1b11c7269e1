"""Tagged target responses and the conversations and pairs made of them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.text import as_text, is_filled
from rewardloom.operators.prompts import message, question_prompt
from rewardloom.options import DatasetOptions


@dataclass(frozen=True)
class ChatTemplate:
    """How a conversation is written out as one text.

    ``start``, then for each message ``before`` role ``between`` content
    ``after``. A NULL role or content is written ``None``: no message is lost.
    """

    start: str = ""
    before: str = "<|"
    between: str = "|>\n"
    after: str = "\n"

    def render(self, messages: Column) -> Column:
        written = F.transform(
            messages,
            lambda m: F.concat(
                F.lit(self.before),
                F.coalesce(m["role"], F.lit("None")),
                F.lit(self.between),
                F.coalesce(m["content"], F.lit("None")),
                F.lit(self.after),
            ),
        )
        return F.concat(F.lit(self.start), F.array_join(written, ""))


def _tagged(tag: str, content: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), content, F.lit(f"</{tag}>"))


def tagged_response(
    df: DataFrame, dataset: DatasetOptions, instead: Mapping[str, str] | None = None
) -> Column:
    """Reasoning and answer in tags, in the first layout that a row can fill.

    1. two stages (think, confidence, think), where all three are filled;
    2. named steps, where at least one is filled; empty ones are left out;
    3. the training column as plain reasoning.

    ``instead`` maps column names to the columns to read in their place. Which
    columns exist is known from the schema, so a layout that the table cannot
    fill costs nothing.
    """
    instead = instead or {}

    def text(name: str) -> Column:
        name = instead.get(name, name)
        return as_text(F.col(name), df.schema[name].dataType)

    def present(name: str) -> Column:
        name = instead.get(name, name)
        return is_filled(F.col(name), df.schema[name].dataType)

    answer = _tagged("answer", text(dataset.answer_column))
    layouts = []

    stages = dataset.two_stage_reasoning
    if stages:
        names = [stages.think1_column, stages.confidence_column, stages.think2_column]
        if set(names) <= set(df.columns):
            complete = present(names[0]) & present(names[1]) & present(names[2])
            think1, confidence, think2 = (text(name) for name in names)
            stage_text = F.concat(
                _tagged("think", think1),
                _tagged("confidence", confidence),
                _tagged("think", think2),
                answer,
            )
            layouts.append(F.when(complete, stage_text))

    steps = {
        step: name
        for step, name in (dataset.multistep_reasoning_columns or {}).items()
        if name in df.columns
    }
    if steps:
        some = F.lit(False)
        parts = []
        for step, name in steps.items():
            some = some | present(name)
            parts.append(F.when(present(name), _tagged(step, text(name))).otherwise(F.lit("")))
        layouts.append(F.when(some, F.concat(*parts, answer)))

    if dataset.sft_column:
        layouts.append(F.concat(_tagged(dataset.reasoning_tag_name, text(dataset.sft_column)), answer))
    if not layouts:
        raise ValueError("no training column is configured")
    return F.coalesce(*layouts)


def conversation(df: DataFrame, dataset: DatasetOptions) -> Column:
    """System, user and assistant message of a training example."""
    prompt = question_prompt(dataset.system_prompt, F.col(dataset.question_column))
    return F.concat(prompt, F.array(message("assistant", tagged_response(df, dataset))))


def training_texts(
    df: DataFrame, dataset: DatasetOptions, template: ChatTemplate, keep: list[str] | None = None
) -> DataFrame:
    """Conversations written out, in a column ``text`` (and those in ``keep``)."""
    return df.select(*(keep or []), template.render(conversation(df, dataset)).alias("text"))


def preference_pairs(
    df: DataFrame, dataset: DatasetOptions, keep: list[str] | None = None
) -> DataFrame:
    """``prompt`` with a ``chosen`` and a ``rejected`` response.

    The rejected one has the comment in place of the training column. Layouts
    that do not read the training column give the same text twice; see
    ``equal_pairs``.
    """
    swap = {dataset.sft_column: dataset.dpo_comment_column}
    return df.select(
        *(keep or []),
        question_prompt(dataset.system_prompt, F.col(dataset.question_column)).alias("prompt"),
        tagged_response(df, dataset).alias("chosen"),
        tagged_response(df, dataset, instead=swap).alias("rejected"),
    )


def equal_pairs() -> Column:
    """Aggregate: pairs whose chosen and rejected responses are the same."""
    return F.count_if(F.col("chosen") == F.col("rejected"))
