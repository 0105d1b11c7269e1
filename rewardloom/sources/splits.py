"""Question tables with named splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.options import DatasetOptions
from rewardloom.sources import arrow_shards


def load_split(
    spark: SparkSession, path: str, split: str | None = None, split_column: str = "split"
) -> DataFrame:
    """One split of a Parquet table, or the whole table.

    With the table partitioned by ``split_column`` only that split's files are
    read. ``split=None`` is for tables without splits. A split without rows is an
    error: its name is probably misspelt.
    """
    table = spark.read.parquet(path)
    if split is None:
        return table
    rows = table.where(F.col(split_column) == split)
    # Looks for one row, in that split's files.
    if rows.select(split_column).isEmpty():
        raise ValueError(f"no split {split!r} in {path}")
    return rows


def load_shards(
    spark: SparkSession, path: str, split: str | None = None, id_column: str = "row_id"
) -> DataFrame:
    """One split of a dataset of Arrow shards, its rows numbered in order."""
    arrow_shards.register(spark)
    reader = spark.read.format("arrow_shards").option("row_id", id_column)
    return (reader if split is None else reader.option("split", split)).load(path)


def _load(spark: SparkSession, dataset: DatasetOptions, path: str, split: str | None) -> DataFrame:
    if dataset.format == "arrow_shards":
        return load_shards(spark, path, split, dataset.id_column)
    if dataset.format == "parquet":
        return load_split(spark, path, split, dataset.split_column)
    raise ValueError(f"unknown dataset format {dataset.format!r}")


def load_splits(spark: SparkSession, dataset: DatasetOptions) -> tuple[DataFrame, DataFrame]:
    """The training and the test split."""
    return (
        _load(spark, dataset, dataset.path, dataset.train_split),
        _load(spark, dataset, dataset.path, dataset.test_split),
    )


def load_sft_table(spark: SparkSession, dataset: DatasetOptions) -> DataFrame | None:
    """The separate table for supervised training, if one is configured.

    Its training split is used when it has splits, else all of it.
    """
    path = dataset.sft_dataset_path
    if not (dataset.sft_column and path):
        return None
    if dataset.format == "arrow_shards":
        with_splits = arrow_shards.has_splits(path)
    else:
        with_splits = dataset.split_column in spark.read.parquet(path).columns
    return _load(spark, dataset, path, dataset.sft_train_split if with_splits else None)


def write_splits(df: DataFrame, path: str, split_column: str = "split") -> None:
    """Write a table so that its splits can be read on their own."""
    df.write.partitionBy(split_column).parquet(path)
