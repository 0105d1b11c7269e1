"""Score completions as they arrive.

Rewards are row-wise and keep no state, so a stream of rollouts is scored by the
same expressions as a table, with no watermark and nothing to recover but the
source's offsets.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rewardloom.plans.scoring import score_rollouts


def write_scores(
    rollouts: DataFrame,
    specs: list[Any],
    path: str,
    checkpoint: str,
    weights: list[float] | None = None,
    keep: list[str] | None = None,
    once: bool = False,
    **columns: str,
) -> StreamingQuery:
    """Score a stream of rollouts into Parquet files, each row exactly once.

    With ``once`` the stream stops when the rows that are there are scored.
    """
    writer = (
        score_rollouts(rollouts, specs, weights, keep, **columns)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
