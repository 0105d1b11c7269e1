"""Group advantage of completions as they arrive.

A prompt's completions come one by one; an advantage needs all of them. The state holds a sample's rewards until ``num_repeats`` different
repeats are there, or until ``patience_ms`` have gone by since its first one, and then gives each its advantage, as ``group_advantage`` does.
So the state of a sample is never more than ``num_repeats`` numbers, whatever arrives for it.

Of a settled sample only a mark stays, for ``memory_ms``. A completion that comes then is late: it is passed on without an advantage
and marked, so that late ones can be counted. A repeat that comes again while its sample is open replaces nothing and is left out, as after a restart of
the producer. Rows without sample, repeat or reward are no completions and are left out.

Timers go by processing time and fire with the next batch. The state is in RocksDB next to the query's checkpoint: a restarted query goes on where it was.
"""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from rewardloom.options import NUM_REPEATS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Whether batches go on without new rows, as timers ask for; with ``once`` they would never end.
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Complete: all repeats were there. Late: came after its sample was settled.
OUTPUT = "sample_id long, repeat_id int, reward double, advantage double, is_complete boolean, is_late boolean"


def advantages_of(rewards: list[float], epsilon: float) -> list[float]:
    """Differences to the mean over the sample deviation plus ``epsilon``."""
    mean = math.fsum(rewards) / len(rewards)
    deviation = math.sqrt(math.fsum((x - mean) ** 2 for x in rewards) / (len(rewards) - 1)) if len(rewards) > 1 else 0.0
    return [(x - mean) / (deviation + epsilon) for x in rewards]


class Groups(StatefulProcessor):
    """Keeps the rewards of open samples, and marks of settled ones."""

    def __init__(self, num_repeats: int, patience_ms: int, memory_ms: int, epsilon: float):
        self.num_repeats, self.patience_ms, self.memory_ms, self.epsilon = num_repeats, patience_ms, memory_ms, epsilon

    def init(self, handle) -> None:
        self.handle = handle
        # One value per sample, as each access is a request to the JVM: when an open sample is to be settled (a settled one: forgotten), and its rewards by repeat.
        self.state = handle.getValueState("sample", "at long, is_settled boolean, repeats array<int>, rewards array<double>")

    def _settled(self, sample: int, rewards: dict, is_complete: bool):
        held = sorted(rewards.items())
        for (repeat, reward), advantage in zip(held, advantages_of([r for _, r in held], self.epsilon), strict=True):
            yield Row(sample_id=sample, repeat_id=repeat, reward=reward, advantage=advantage, is_complete=is_complete, is_late=False)

    def handleInputRows(self, key, rows, timerValues):
        now, sample = timerValues.getCurrentProcessingTimeInMs(), key[0]
        found = self.state.get()
        before, is_settled, repeats, values = found if found is not None else (None, False, [], [])
        rewards = dict(zip(repeats, values, strict=True))
        at, was_settled, had = before, is_settled, len(rewards)
        for row in rows:
            if is_settled:
                yield Row(sample_id=sample, repeat_id=row["repeat_id"], reward=row["reward"], advantage=None, is_complete=False, is_late=True)
                continue
            if row["repeat_id"] in rewards:
                continue
            rewards[row["repeat_id"]] = row["reward"]
            if len(rewards) == self.num_repeats:
                yield from self._settled(sample, rewards, True)
                at, is_settled = now + self.memory_ms, True
            elif at is None:
                at = now + self.patience_ms
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
        if is_settled and not was_settled:
            self.state.update((at, True, [], []))
        elif len(rewards) > had:
            self.state.update((at, False, list(rewards), list(rewards.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, is_settled, repeats, values = self.state.get()
        if is_settled:
            self.state.clear()
            return
        # The timer that fired is no longer there to be deleted.
        yield from self._settled(key[0], dict(zip(repeats, values, strict=True)), False)
        at = timerValues.getCurrentProcessingTimeInMs() + self.memory_ms
        self.state.update((at, True, [], []))
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def streamed_advantages(
    scores: DataFrame,
    reward: str = "reward_total",
    num_repeats: int = NUM_REPEATS,
    patience_ms: int = 3_600_000,
    memory_ms: int = 86_400_000,
    epsilon: float = 1e-4,
) -> DataFrame:
    """Advantages of a stream of scores (sample_id, repeat_id and ``reward``)."""
    if num_repeats < 1:
        raise ValueError("a sample has at least one repeat")
    rows = scores.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("repeat_id").cast("int").alias("repeat_id"), F.col(reward).cast("double").alias("reward"))
    # The process that starts the processor on the driver may not have this package on its path.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    groups = Groups(num_repeats, patience_ms, memory_ms, epsilon)
    return rows.dropna().groupBy("sample_id").transformWithState(groups, OUTPUT, "Append", "ProcessingTime")


def write_advantages(scores: DataFrame, path: str, checkpoint: str, once: bool = False, **settings) -> StreamingQuery:
    """Write the advantages of a stream of scores as Parquet files, each completion exactly once.

    With ``once`` the stream stops when the rows that are there are dealt with; samples that are still open wait in the checkpoint.
    """
    spark: SparkSession = scores.sparkSession
    settings_here = {PROVIDER: ROCKSDB, **({IDLE_BATCHES: "false"} if once else {})}
    before = {name: spark.conf.get(name) for name in settings_here}
    stream = streamed_advantages(scores, **settings)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    # A query keeps the settings it was started with.
    for name, value in settings_here.items():
        spark.conf.set(name, value)
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
