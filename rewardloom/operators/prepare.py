"""Question tables: checks, duplicate questions, usable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str], purpose: str) -> None:
    """Raise ``ValueError`` when ``df`` lacks a column that ``purpose`` needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{purpose} needs column(s) {', '.join(missing)}")


def require_topic(topic: Column) -> Column:
    """The topic; fails the query on a row without one."""
    message = F.lit("few-shot prompts need a topic on every test row")
    return F.coalesce(F.nullif(topic, F.lit("")), F.raise_error(message).cast("string"))


def without_topic(df: DataFrame, topic: str = "topic") -> DataFrame:
    """The rows that ``require_topic`` would fail on, to be put aside."""
    return df.where(F.coalesce(F.col(topic), F.lit("")) == "")


def counted(df: DataFrame, kept: Column, observation: Observation | None) -> DataFrame:
    """``df`` with the rows before and after a filter counted while it is read."""
    if observation is None:
        return df
    after = F.count_if(kept).alias("rows_after")
    return df.observe(observation, F.count(F.lit(1)).alias("rows_before"), after)


class RowCounts:
    """Rows before and after a step that isn't a filter on single rows, counted where they enter and where they leave it."""

    def __init__(self, name: str | None = None):
        self.before, self.after = (Observation(f"{name} {side}" if name else None) for side in ("before", "after"))

    @property
    def get(self) -> dict[str, int]:
        """``rows_before`` and ``rows_after``, once the table was used."""
        return {"rows_before": self.before.get["rows"], "rows_after": self.after.get["rows"]}


def keep_first(
    df: DataFrame, column: str, id_column: str = "row_id", observation: RowCounts | None = None
) -> DataFrame:
    """One row per value of ``column``: the one with the lowest id.

    NULL is one value. Without the column the table is returned as it is.

    Ranking with a limit of one runs before the shuffle too, so each map task
    sends at most one row per value and a value that fills a third of the table
    costs no more than any other. Sorting is led by an 8-byte hash; the long
    value itself is compared only where hashes meet, which keeps the result
    exact. An ``observation`` counts the rows as they are read and those that are kept; the limit stays between.
    """
    rows = F.count(F.lit(1)).alias("rows")
    if observation:
        df = df.observe(observation.before, rows)
    if column not in df.columns:
        return df.observe(observation.after, rows) if observation else df
    same_value = Window.partitionBy(F.xxhash64(column), F.col(column)).orderBy(id_column)
    rank = "_rank_in_duplicates"
    kept = df.withColumn(rank, F.row_number().over(same_value)).where(F.col(rank) == 1).drop(rank)
    return kept.observe(observation.after, rows) if observation else kept


def filled(*columns: str) -> Column:
    """True where every column holds a value: neither NULL nor an empty text."""
    condition = F.lit(True)
    for column in columns:
        condition = condition & F.col(column).isNotNull() & (F.col(column).cast("string") != "")
    return condition


def keep_filled(
    df: DataFrame, *columns: str, observation: Observation | None = None
) -> DataFrame:
    """Rows in which every column holds text.

    With an ``observation``, the row counts before and after (``rows_before``,
    ``rows_after``) are collected while the table is used, without a job of
    their own.
    """
    return counted(df, filled(*columns), observation).where(filled(*columns))
