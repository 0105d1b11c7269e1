"""Compare the completions of one prompt, and report on rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.scratch import materialize


def group_advantage(
    rewards: DataFrame,
    reward: str = "reward_total",
    group: str = "sample_id",
    epsilon: float = 1e-4,
) -> DataFrame:
    """Add ``advantage``: a reward relative to the group it belongs to.

    The difference to the group's mean over its (sample) standard deviation plus
    ``epsilon``; 0 in a group of one. Group statistics are pre-aggregated before
    the shuffle, written (one row per group) and joined back: no task has to hold
    a group, and a join with a written table is split where a group is large.

    The rewards are read twice: write them first (or pass a written table)
    unless computing them is cheap.
    """
    statistics = rewards.groupBy(group).agg(
        F.avg(reward).alias("_mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_sd")
    )
    statistics = materialize(statistics, "statistics")
    advantage = (F.col(reward) - F.col("_mean")) / (F.col("_sd") + epsilon)
    return (
        rewards.join(statistics, group).withColumn("advantage", advantage).drop("_mean", "_sd")
    )


def reward_report(scores: DataFrame, rewards: list[str]) -> DataFrame:
    """Mean, deviation, extremes and share of non-zero values of each reward.

    All rewards are aggregated in one pass, and the single row that results is
    turned into one row per reward, rather than every row beforehand.
    """

    def statistics(name: str):
        c = F.col(name)
        scored = F.count(c)
        nonzero = F.try_divide(F.count_if(c != 0).cast("double"), scored)
        return F.struct(
            F.lit(name).alias("reward"),
            scored.alias("scored"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("stddev"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            nonzero.alias("share_nonzero"),
        )

    rows = scores.agg(F.array(*[statistics(name) for name in rewards]).alias("rows"))
    return rows.select(F.inline("rows"))
