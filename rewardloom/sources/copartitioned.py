"""Tables stored by sample, so that joins and group statistics move no row.

``store`` writes a table into buckets of its key, one file each, with the hash Spark shuffles by. Two tables stored ``like`` one
another have a sample's rows in buckets of the same number, and Spark joins and groups them where they are read.

A sample with more rows than an average bucket would be one long task. Such samples, of which there can't be more than there are
buckets, are kept apart and dealt by key and ``within`` together, which spreads their rows; joins on both columns move nothing there either,
and what belongs to the sample as a whole (a true answer, its group's statistics) is at most one row for each of them, which is broadcast.

Rows travel to their buckets packed: what a batch of rows has for one bucket is one compressed value, so that texts that a sample's rows share are moved
about once. Files are compressed by Zstandard for the same reason. Spark's own shuffle compresses 32 KB at a time, in which long texts don't come twice.

A table is a folder: ``even`` and ``hot`` with the rows, ``layout`` with the layout, ``keys`` with the hot keys. It needs no metastore: ``load`` registers
the folders anew. NULL keys are one sample in the layout and, as everywhere, equal to nothing in a join; an empty table has empty folders.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.packing import PACKED, pack, packable, unpacked

#: Spark plans a join on key and ``within`` in buckets of the key alone only where this is "false". ``load`` sets it for the session, as
#: planning comes with the action; in these tables no key has more rows than a bucket, which is what the default guards against.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass(frozen=True)
class Stored:
    """A stored table: rows by key, rows of hot samples by key and ``within``, and the hot keys."""

    even: DataFrame
    hot: DataFrame
    keys: DataFrame
    key: str
    within: str | None
    buckets: int

    def rows(self) -> DataFrame:
        return self.even.unionByName(self.hot)


def _registered(spark: SparkSession, path: str, schema, columns: list[str], buckets: int) -> DataFrame:
    """The bucketed files of ``path`` as a table of this session."""
    name = f"stored_{uuid.uuid4().hex}"
    names = ", ".join(f"`{c}`" for c in columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    location = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({names}) SORTED BY ({names}) INTO {buckets} BUCKETS LOCATION '{location}'")
    return spark.table(name)


def _dealt(df: DataFrame, columns: list[str], buckets: int, pack_rows: bool) -> DataFrame:
    """``df`` with a bucket's rows in the partition of its number."""
    narrow = all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for f in df.schema)
    if narrow or not pack_rows or not all(packable(f.dataType) for f in df.schema):
        return df.repartition(buckets, *columns)

    def unpack(batches):
        for batch in batches:
            for value in batch.column(1):
                yield from unpacked(value)

    # The hash of Spark's buckets.
    number = F.pmod(F.hash(*columns), F.lit(buckets)).alias("bucket")
    packed = df.select(number, "*").mapInArrow(pack, PACKED)
    return packed.repartitionById(buckets, "bucket").mapInArrow(unpack, df.schema)


def _write(df: DataFrame, path: str, columns: list[str], buckets: int, pack_rows: bool) -> None:
    # The same hash as the buckets': each task has one bucket and writes one file.
    name = f"written_{uuid.uuid4().hex}"
    writer = _dealt(df, columns, buckets, pack_rows).write.format("parquet").option("compression", "zstd").bucketBy(buckets, *columns).sortBy(*columns)
    writer.option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def hot_keys(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Keys with more rows than an average bucket: fewer than ``buckets``."""
    counts = df.groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("n"))
    total = df.select(F.count("*").alias("total"))
    # One row, which counts all.
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") * buckets > F.col("total")).select("hot_key")


def store(df: DataFrame, path: str, key: str = "sample_id", within: str | None = "repeat_id", buckets: int | None = None, like: Stored | None = None) -> Stored:
    """Write ``df`` by ``key``, with the layout of ``like`` where given; ``within`` is None for tables with one row a sample.

    The rows are read three times (counts, even, hot): pass a written table unless computing them is cheap.
    """
    spark = df.sparkSession
    if buckets and like and like.buckets != buckets:
        raise ValueError(f"{like.buckets} buckets in the other table, {buckets} asked for")
    if within == key:
        raise ValueError("within must tell rows of one sample apart")
    buckets = like.buckets if like else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path.rstrip("/")
    keys = like.keys if like else hot_keys(df, key, buckets)
    keys.write.parquet(f"{path}/keys")
    keys = spark.read.schema(keys.schema).parquet(f"{path}/keys")
    # Fewer rows than buckets, by construction.
    match = df[key].eqNullSafe(keys["hot_key"])
    # Of a sample's only row there is nothing to find again; no hot keys, no hot rows.
    several = within is not None
    _write(df.join(F.broadcast(keys), match, "left_anti"), f"{path}/even", [key], buckets, several)
    _write(df.join(F.broadcast(keys), match, "left_semi"), f"{path}/hot", [key, *([within] if within else [])], buckets, several and not keys.isEmpty())
    layout = {"key": key, "within": within, "buckets": buckets, "schema": json.loads(df.schema.json())}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.text(f"{path}/layout")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Stored:
    """A stored table of this or another session."""
    from pyspark.sql.types import StructType

    spark.conf.set(CO_PARTITION, "false")
    path = path.rstrip("/")
    layout = json.loads(spark.read.text(f"{path}/layout").first()["value"])
    schema = StructType.fromJson(layout["schema"])
    key, within, buckets = layout["key"], layout["within"], layout["buckets"]
    even = _registered(spark, f"{path}/even", schema, [key], buckets)
    hot = _registered(spark, f"{path}/hot", schema, [key, *([within] if within else [])], buckets)
    kind = schema[key].dataType.simpleString()
    return Stored(even, hot, spark.read.schema(f"hot_key {kind}").parquet(f"{path}/keys"), key, within, buckets)


def _together(left: Stored, right: Stored) -> None:
    if (left.buckets, left.key) != (right.buckets, right.key):
        raise ValueError("the tables have different layouts; store one like the other")


def with_ground_truth(rollouts: Stored, samples: Stored, columns: list[str]) -> DataFrame:
    """``attach_ground_truth`` over stored tables: no rollout is moved."""
    _together(rollouts, samples)
    key = rollouts.key
    even = rollouts.even.join(samples.even.select(key, *columns), key, "left")
    few = samples.hot.select(key, *columns)
    # A row for each hot key, unless the samples repeat.
    if few.limit(2 * rollouts.buckets + 1).count() <= 2 * rollouts.buckets:
        few = F.broadcast(few)
    return even.unionByName(rollouts.hot.join(few, key, "left"))


def with_model_outputs(rollouts: Stored, outputs: Stored, columns: list[str]) -> DataFrame:
    """``attach_model_outputs`` over stored tables: neither side is moved."""
    _together(rollouts, outputs)
    if rollouts.within is None or rollouts.within != outputs.within:
        raise ValueError("the tables tell a sample's rows apart by different columns")
    on = [rollouts.key, rollouts.within]
    join = lambda a, b: a.join(b.select(*on, *columns), on, "left")
    return join(rollouts.even, outputs.even).unionByName(join(rollouts.hot, outputs.hot))


def with_group_advantage(rewards: Stored, reward: str = "reward_total", epsilon: float = 1e-4) -> DataFrame:
    """``group_advantage`` over a stored table: even samples are grouped and joined in their buckets.

    Of hot samples, partial statistics are all that is shuffled; fewer rows than buckets come back.
    """

    def statistics(df: DataFrame) -> DataFrame:
        return df.groupBy(rewards.key).agg(F.avg(reward).alias("_mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_sd"))

    advantage = ((F.col(reward) - F.col("_mean")) / (F.col("_sd") + epsilon)).alias("advantage")
    parts = [(rewards.even, statistics(rewards.even)), (rewards.hot, F.broadcast(statistics(rewards.hot)))]
    found = [rows.join(each, rewards.key).select(*[f"`{c}`" for c in rows.columns], advantage) for rows, each in parts]
    return found[0].unionByName(found[1])
