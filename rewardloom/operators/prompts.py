"""Chat prompts as arrays of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.text import as_text
from rewardloom.options import DatasetOptions


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def question_prompt(system_prompt: str, question: Column) -> Column:
    """System and user message."""
    return F.array(
        message("system", F.lit(system_prompt)), message("user", question.cast("string"))
    )


def add_prompts(df: DataFrame, dataset: DatasetOptions) -> DataFrame:
    """Add ``prompt``, ``answers`` and ``answer_only``.

    With a reasoning column, rows that have reasoning (an empty one counts) get
    it as the start of the assistant's reply and are marked ``answer_only``.
    """
    prompt = question_prompt(dataset.system_prompt, F.col(dataset.question_column))
    answer_only = F.lit(False)
    if dataset.reasoning_column:
        reasoning = F.col(dataset.reasoning_column)
        answer_only = reasoning.isNotNull()
        prefilled = F.concat(prompt, F.array(message("assistant", reasoning)))
        prompt = F.when(answer_only, prefilled).otherwise(prompt)
    return df.withColumns(
        {"prompt": prompt, "answers": F.col(dataset.answer_column), "answer_only": answer_only}
    )


def last_content(prompt: Column) -> Column:
    """Content of the last message, ``''`` for a prompt without messages.

    This is the question, or the reasoning where that was prefilled.
    """
    # Not element_at: inlined over an array literal it breaks code generation.
    return F.coalesce(F.get(F.reverse(prompt), 0)["content"], F.lit(""))


def example_line(df: DataFrame, prompt: str = "prompt", answers: str = "answers") -> Column:
    """One solved question of a few-shot prompt."""
    answer = as_text(F.col(answers), df.schema[answers].dataType)
    return F.concat(
        F.lit("Question: "), last_content(F.col(prompt)), F.lit("\nAnswer: "), answer
    )


def few_shot_prompt(examples: Column, question: Column) -> Column:
    """The solved questions, then the open one; examples may be empty."""
    context = F.array_join(examples, "\n\n")
    return F.concat(context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))
