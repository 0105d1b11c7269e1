"""Compare responses with the true answers and summarise the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import parse
from rewardloom.functions.text import first_word, has_pair, strip
from rewardloom.operators.prompts import last_content
from rewardloom.operators.rollouts import UNIFORM_PROBABILITY, option_probabilities
from rewardloom.schemas import OPTIONS, RESULT_COLUMNS

PROBABILITIES = [f"answer_prob_{option}" for option in OPTIONS]


def _probability_columns(logits: dict[str, str], response: Column | None) -> dict[str, Column]:
    columns = {option: F.col(name) for option, name in logits.items()}
    return {
        f"answer_prob_{option}": value
        for option, value in option_probabilities(columns, response).items()
    }


def _logit_columns(logits: dict[str, str] | None) -> dict[str, str]:
    return {o: f"logit_{o.lower()}" for o in OPTIONS} if logits is None else logits


def evaluate_responses(
    rollouts: DataFrame,
    *,
    response: str = "response",
    ground_truth: str = "ground_truth",
    logits: dict[str, str] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Judge every rollout; one projection, no shuffle.

    Returns all rollouts with the result columns, those in ``carry`` and
    ``is_error``: a response that could not be generated (NULL), or one that
    was parsed but has no ground truth to compare with. Errors count in totals
    but are no results.
    """
    text, truth = F.col(response), F.col(ground_truth)
    parsed = rollouts.withColumns(
        {
            "predicted_answer": parse.evaluated_answer(text),
            "parsed_successfully": parse.is_parsed(text),
            "confidence_score": F.when(
                has_pair(text, "answer"), parse.lenient_confidence(text)
            ),
            **_probability_columns(_logit_columns(logits), text),
        }
    )
    is_parsed = F.col("parsed_successfully")
    right = parse.same_answer(F.col("predicted_answer"), truth)
    values = {
        "question": last_content(F.col("prompt")),
        "ground_truth": truth,
        "full_response": text,
        "is_correct": F.coalesce(is_parsed & right, F.lit(False)),
    }
    return parsed.select(
        *[values[name].alias(name) if name in values else name for name in RESULT_COLUMNS],
        *(carry or []),
        (text.isNull() | (is_parsed & truth.isNull())).alias("is_error"),
    )


def evaluate_few_shot(
    rollouts: DataFrame,
    *,
    response: str = "response",
    ground_truth: str = "ground_truth",
    logits: dict[str, str] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Judge untagged few-shot replies by their first word.

    Whether a reply is correct does not depend on whether it is one of the
    option letters. Expects ``full_prompt`` and ``context_examples_count``.
    """
    text, truth = strip(F.col(response)), F.col(ground_truth)
    predicted = first_word(text)
    letter = F.upper(predicted)
    values = {
        "question": last_content(F.col("prompt")),
        "predicted_answer": predicted,
        "ground_truth": truth,
        "full_response": text,
        "full_prompt": F.col("full_prompt"),
        "context_examples_count": F.col("context_examples_count"),
        "parsed_successfully": letter.isin(*OPTIONS),
        "is_correct": F.coalesce(letter == F.upper(strip(truth)), F.lit(False)),
        **_probability_columns(_logit_columns(logits), None),
    }
    return rollouts.select(
        "sample_id",
        "repeat_id",
        *[value.alias(name) for name, value in values.items()],
        *(carry or []),
        (text.isNull() | truth.isNull()).alias("is_error"),
    )


def result_rows(evaluated: DataFrame) -> DataFrame:
    """The results: evaluated rows that are not errors."""
    return evaluated.where(~F.col("is_error")).drop("is_error")


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _averaged(column: str) -> Column:
    return F.avg(F.when(~F.col("is_error"), F.col(column)))


def summarize(
    evaluated: DataFrame, by: list[str] | None = None, samples: DataFrame | None = None
) -> DataFrame:
    """The evaluation summary, overall or per group.

    Errors count as unparseable responses; averages are over results only and
    skip missing values. ``samples`` is the table of samples that were to be
    evaluated; without it, the samples seen are counted.

    Samples are counted in a narrow aggregation of their own: counted together
    with the metrics, all partial metrics would be shuffled per sample instead
    of once per task.
    """
    by = by or []
    is_result = ~F.col("is_error")
    unparseable = F.col("is_error") | ~F.col("parsed_successfully")
    processed, total = F.count_if(is_result), F.count(F.lit(1))
    has_probability = F.count_if(is_result & F.col("answer_prob_A").isNotNull())
    has_confidence = F.count_if(is_result & F.col("confidence_score").isNotNull())
    metrics = {
        "test_samples_processed": processed,
        "total_responses": total,
        "correct_answers": F.count_if(is_result & F.col("is_correct")),
        "unparseable_answers": F.count_if(unparseable),
        "accuracy": _rate(F.count_if(is_result & F.col("is_correct")), total),
        "parsing_success_rate": _rate(F.count_if(~unparseable), total),
        **{
            f"avg_{name}": F.coalesce(_averaged(name), F.lit(UNIFORM_PROBABILITY))
            for name in PROBABILITIES
        },
        "avg_confidence": _averaged("confidence_score"),
        "confidence_availability_rate": _rate(has_confidence, processed),
        "probability_extraction_success_rate": _rate(has_probability, processed),
    }
    summary = evaluated.groupBy(*by).agg(*[v.alias(k) for k, v in metrics.items()])

    if samples is None:
        samples = evaluated.select(*by, "sample_id").distinct()
    counted = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("test_samples_total"))
    # The two small results are put together by a second aggregation, which,
    # unlike a join, also works without group columns and keeps NULL groups.
    both = summary.unionByName(counted, allowMissingColumns=True)
    names = list(metrics)
    names.insert(1, "test_samples_total")
    zero = {"test_samples_processed", "test_samples_total", "total_responses"}
    merged = both.groupBy(*by).agg(*[F.max(name).alias(name) for name in names])
    return merged.select(
        *by, *[F.coalesce(name, F.lit(0)).alias(name) if name in zero else name for name in names]
    )


def result_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics over result rows only, as reported after training.

    Errors are not among the results, so rates differ from ``summarize``.
    """
    total = F.count(F.lit(1))
    correct = F.count_if("is_correct")
    unparseable = F.count_if(~F.col("parsed_successfully"))
    return results.groupBy(*(by or [])).agg(
        _rate(correct, total).alias("accuracy"),
        _rate(total - unparseable, total).alias("parsing_success_rate"),
        correct.alias("correct_answers"),
        total.alias("total_answers"),
        unparseable.alias("unparseable_answers"),
    )


def few_shot_metrics(
    evaluated: DataFrame, num_repeats: int, by: list[str] | None = None
) -> DataFrame:
    """Metrics of a few-shot evaluation; errors count as unparseable answers."""
    total = F.count(F.lit(1))
    correct = F.count_if(~F.col("is_error") & F.col("is_correct"))
    unparseable = F.count_if(F.col("is_error") | ~F.col("parsed_successfully"))
    return evaluated.groupBy(*(by or [])).agg(
        _rate(correct, total).alias("accuracy"),
        _rate(total - unparseable, total).alias("parsing_success_rate"),
        correct.alias("correct_answers"),
        total.alias("total_answers"),
        unparseable.alias("unparseable_answers"),
        F.lit(num_repeats).alias("num_repeats"),
    )


def sample_table(results: DataFrame, limit: int | None = 100) -> DataFrame:
    """Results for display, with long questions cut; the first 100 by default."""
    question = F.col("question")
    shown = F.when(
        F.length(question) > 100, F.concat(F.substring(question, 1, 100), F.lit("..."))
    ).otherwise(question)
    table = results.select(
        "sample_id",
        "repeat_id",
        shown.alias("question"),
        "predicted_answer",
        "ground_truth",
        "is_correct",
        "parsed_successfully",
        *[F.col(f"answer_prob_{option}").alias(f"prob_{option}") for option in OPTIONS],
    )
    # Without a limit the order is left to the reader: a full sort buys nothing.
    return table if limit is None else table.orderBy("sample_id", "repeat_id").limit(limit)
