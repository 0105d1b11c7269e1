"""Evaluation summaries as states that merge, so that a summary over many runs reads no rollout again.

A state has, per group, counts and sums of the metrics, and which samples were seen, as exact bitmaps of 32,768 sample numbers each. States of
different runs, days or shards are added up: counts and sums by addition, bitmaps by OR, so a sample that several of them
saw counts once. Averages and rates are made from the sums at the end.

States are kept as two tables per run, ``metrics`` and ``samples``, partitioned by ``run``; writing a run again replaces it.
A merged state is a state too, so old runs can be compacted into one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.operators.evaluate import PROBABILITIES
from rewardloom.operators.rollouts import UNIFORM_PROBABILITY

#: Counted or summed columns of ``metrics``.
COUNTS = ["total_responses", "processed", "correct", "unparseable", "with_probability", "with_confidence"]
SUMS = [*[f"sum_{name}" for name in PROBABILITIES], *[f"n_{name}" for name in PROBABILITIES], "sum_confidence"]
MEASURES = [*COUNTS, *SUMS]


@dataclass(frozen=True)
class EvaluationState:
    """``metrics``: groups with counts and sums; ``samples``: groups, bucket and bitmap of sample numbers, NULL where a sample has no number."""

    metrics: DataFrame
    samples: DataFrame
    by: tuple[str, ...] = ()


def state_of(evaluated: DataFrame, by: list[str] | None = None) -> EvaluationState:
    """The state of evaluated rows. One row per task and group is shuffled for the metrics, one bitmap per task, group and bucket for the samples."""
    by = by or []
    is_result = ~F.col("is_error")
    count = lambda c: F.count_if(c)
    measures: dict[str, Column] = {
        "total_responses": F.count(F.lit(1)),
        "processed": count(is_result),
        "correct": count(is_result & F.col("is_correct")),
        "unparseable": count(F.col("is_error") | ~F.col("parsed_successfully")),
        "with_probability": count(is_result & F.col("answer_prob_A").isNotNull()),
        "with_confidence": count(is_result & F.col("confidence_score").isNotNull()),
        "sum_confidence": F.sum(F.when(is_result, F.col("confidence_score"))),
    }
    for name in PROBABILITIES:
        measures[f"sum_{name}"] = F.sum(F.when(is_result, F.col(name)))
        measures[f"n_{name}"] = count(is_result & F.col(name).isNotNull())
    metrics = evaluated.groupBy(*by).agg(*[measures[name].alias(name) for name in MEASURES])
    sample = F.col("sample_id").cast("long")
    samples = evaluated.groupBy(*by, F.bitmap_bucket_number(sample).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(sample)).alias("bitmap"))
    return EvaluationState(metrics, samples, tuple(by))


def merged(states: list[EvaluationState]) -> EvaluationState:
    """One state from several with the same groups."""
    if len({state.by for state in states}) != 1:
        raise ValueError("states to merge must have the same groups")
    by = list(states[0].by)
    metrics = reduce(DataFrame.unionByName, [s.metrics for s in states]).groupBy(*by).agg(*[F.sum(name).alias(name) for name in MEASURES])
    samples = reduce(DataFrame.unionByName, [s.samples for s in states]).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return EvaluationState(metrics, samples, tuple(by))


def coarser(state: EvaluationState, by: list[str] | None = None) -> EvaluationState:
    """The state of fewer group columns, e.g. overall from per topic."""
    by = by or []
    if not set(by) <= set(state.by):
        raise ValueError(f"no such groups in the state: {sorted(set(by) - set(state.by))}")
    return merged([EvaluationState(state.metrics.select(*by, *MEASURES), state.samples.select(*by, "bucket", "bitmap"), tuple(by))])


def summary_of(state: EvaluationState) -> DataFrame:
    """The columns of ``summarize`` from a state."""
    by = list(state.by)
    # A NULL sample number is one sample, in a bucket that is NULL and has an empty bitmap.
    seen = F.sum(F.bitmap_count("bitmap") + F.when(F.col("bucket").isNull(), 1).otherwise(0))
    counted = state.samples.groupBy(*by).agg(seen.alias("test_samples_total"))
    both = state.metrics.groupBy(*by).agg(*[F.sum(name).alias(name) for name in MEASURES]).unionByName(counted, allowMissingColumns=True)
    rows = both.groupBy(*by).agg(*[F.max(name).alias(name) for name in (*MEASURES, "test_samples_total")])
    c = {name: F.coalesce(F.col(name), F.lit(0)) for name in (*COUNTS, "test_samples_total")}
    rate = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
    return rows.select(
        *by,
        c["processed"].alias("test_samples_processed"),
        c["test_samples_total"].alias("test_samples_total"),
        c["total_responses"].alias("total_responses"),
        c["correct"].alias("correct_answers"),
        c["unparseable"].alias("unparseable_answers"),
        rate(c["correct"], c["total_responses"]).alias("accuracy"),
        rate(c["total_responses"] - c["unparseable"], c["total_responses"]).alias("parsing_success_rate"),
        *[F.coalesce(F.try_divide(F.col(f"sum_{n}"), F.col(f"n_{n}")), F.lit(UNIFORM_PROBABILITY)).alias(f"avg_{n}") for n in PROBABILITIES],
        F.try_divide(F.col("sum_confidence"), F.col("with_confidence")).alias("avg_confidence"),
        rate(c["with_confidence"], c["processed"]).alias("confidence_availability_rate"),
        rate(c["with_probability"], c["processed"]).alias("probability_extraction_success_rate"),
    )


def write_state(state: EvaluationState, path: str, run: str) -> None:
    """Keep a run's state under ``path``; a run of that name is replaced."""
    for name in ("metrics", "samples"):
        getattr(state, name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/run={run}")


def read_state(spark: SparkSession, path: str, by: list[str] | None = None, runs: list[str] | None = None) -> EvaluationState:
    """The merged state of all runs under ``path``, or of those named; folders of other runs aren't read."""
    by, tables = by or [], []
    for name in ("metrics", "samples"):
        df = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        df = df.where(F.col("run").cast("string").isin(runs)) if runs is not None else df
        tables.append(df.drop("run"))
    return merged([EvaluationState(*tables, tuple(by))])
