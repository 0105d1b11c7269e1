"""From stored question tables to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rewardloom.operators.prepare import RowCounts, keep_first
from rewardloom.operators.prompts import add_prompts
from rewardloom.operators.sampling import exact_fraction
from rewardloom.options import Options
from rewardloom.scratch import materialize
from rewardloom.sources.splits import load_splits


def prepare(
    train: DataFrame,
    test: DataFrame,
    options: Options,
    dedup: bool = True,
    observation: RowCounts | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Prompts of both splits.

    In this order: duplicate questions are dropped from both splits, a fraction
    of the training split is sampled, prompts are added. The sample counts rows
    first, so the deduplicated table is written in between; otherwise each
    count would deduplicate again. An ``observation`` counts the training rows
    before and after deduplication.
    """
    dataset = options.dataset
    if dedup:
        train = keep_first(train, dataset.dedup_column, dataset.id_column, observation)
        test = keep_first(test, dataset.dedup_column, dataset.id_column)
    if dataset.subset_fraction is not None:
        if dedup:
            train = materialize(train, "deduplicated")
        train = exact_fraction(
            train, dataset.subset_fraction, options.random_seed, dataset.id_column
        )
    return add_prompts(train, dataset), add_prompts(test, dataset)


def prepare_from(
    spark: SparkSession, options: Options, dedup: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``prepare`` for the splits at ``options.dataset.path``."""
    return prepare(*load_splits(spark, options.dataset), options, dedup)
