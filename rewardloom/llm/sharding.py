"""Sharding by extendible hashing (operator 7).

A directory is indexed by the leading bits of a row's hash. It starts as one
bucket; only a bucket above the byte limit splits on another bit, until every
shard fits. Bytes per prefix are aggregated ``STEP`` bits at a time, before
anything is shuffled; the levels in between are sums of these, so a round finds all splits of
``STEP`` bits at once, and only rows of buckets that are still too large go into the next.

The path has 192 bits: the MD5 digest of identifier and text, then a hash of the row's number, which
tells repeated rows apart. So only a single row above the limit makes a larger
shard, which then holds that row alone.

A row's bytes are those of all its columns: its strings and binary values, whatever their depth eight bytes or so for each other value, and
eight for each column itself. So rows without text fill a shard too.

Defined results: NULL and empty texts have the bytes of their row's other values; NULL identifiers are hashed
as such; repeated rows are placed each; an empty table has no shards; other columns pass
through, and a column with a result's name is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.llm.common import column, named, table
from rewardloom.scratch import materialize

LIMIT = 64 << 20
#: Bits per round, and of the whole path.
STEP, BITS = 16, 192
#: Bytes of a column of a row, besides its strings.
CELL = 8

ADDED = ("n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def bytes_of(docs: DataFrame, names: tuple[str, ...]) -> Column:
    """The bytes of a row's columns: strings and binaries by their length, nested values by that of their JSON text."""
    total = F.lit(CELL * len(names)).cast("long")
    for field in (docs.schema[named(docs, c)] for c in names):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        total = total + F.coalesce(F.octet_length(value), F.lit(0))
    return total


def sized(docs: DataFrame, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """(row, n_bytes, bits): ``bits`` is the path, as text of zeros and ones. Written, so that paths stay."""
    digest = F.md5(F.concat(F.coalesce(column(docs, key, "string"), F.lit("-")), F.lit(":"), F.coalesce(column(docs, text, "string"), F.lit(""))))
    halves = [F.conv(F.substring(digest, k, 8), 16, 2) for k in (1, 9, 17, 25)]
    bits = [*[F.lpad(h, 32, "0") for h in halves], F.lpad(F.bin(F.xxhash64(F.monotonically_increasing_id())), 64, "0")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    # A shard is written with all columns, also where only some are asked for here.
    return materialize(docs.select(row, bytes_of(docs, tuple(docs.columns)).alias("n_bytes"), F.concat(*bits).alias("bits")), "sized")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(cell, shard, shard_bytes, shard_rows): the shard of each path prefix ``cell`` of a multiple of ``STEP`` bits."""
    found = []
    left = rows.select("bits", "n_bytes")
    for depth in range(STEP, BITS + 1, STEP):
        cells = materialize(left.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r")), "cells")
        levels = cells.select("cell", "b", "r", F.explode(F.sequence(F.lit(depth - STEP), F.lit(depth))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        buckets = levels.groupBy("prefix", "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"))
        fits = F.expr(f"shard_bytes <= {limit} OR shard_rows = 1 OR depth = {BITS}")
        # The shortest prefix that fits is the shard: longer ones fit too, but were never split off.
        leaves = buckets.where(fits)
        of = levels.join(leaves.select("prefix", "shard_bytes", "shard_rows"), "prefix").groupBy("cell").agg(
            F.min(F.struct("depth", F.col("prefix").alias("shard"), "shard_bytes", "shard_rows")).alias("s")
        )
        settled = materialize(of.select("cell", "s.shard", "s.shard_bytes", "s.shard_rows"), "shards")
        found.append(settled)
        open_ = cells.join(settled.select("cell"), "cell", "left_anti").select("cell")
        if open_.isEmpty():
            break
        left = left.withColumn("cell", F.substring("bits", 1, depth)).join(open_, "cell", "left_semi").select("bits", "n_bytes")
    return reduce(DataFrame.unionByName, found)


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with its bytes and shard: the shard's hash prefix, its bits, bytes and rows."""
    keep = tuple(keep or docs.columns)
    if clash := {c.lower() for c in keep} & set(ADDED):
        raise ValueError(f"columns {sorted(clash)} are in the table already")
    rows = sized(docs, key, text, keep)
    shards = materialize(directory(rows, limit), "directory")
    depths = [r[0] for r in shards.select(F.length("cell")).distinct().collect()]
    parts = []
    for depth in sorted(depths):
        cells = shards.where(F.length("cell") == depth)
        parts.append(rows.withColumn("cell", F.substring("bits", 1, depth)).join(cells, "cell"))
    if not parts:
        parts = [rows.withColumn("cell", F.col("bits")).join(shards, "cell")]
    placed = reduce(DataFrame.unionByName, parts)
    return placed.select("row.*", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows")


def write(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """One folder ``shard=<bits>`` of Parquet per shard, each written by one task; the root's bits are ``root``."""
    placed = assign(docs, limit, key, text).withColumn("shard", F.when(F.col("shard") == "", "root").otherwise(F.col("shard")))
    placed.repartition("shard").drop("n_bytes", "depth", "shard_bytes", "shard_rows").write.partitionBy("shard").parquet(path)


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the shard of every document."""
    return assign(table(spark, sf_dir, "documents"), keep=("doc_id",))


QUERIES = {"op7_sharding": sharding}

#: Splits bucket by bucket; repeated rows, which a further hash tells apart, are out of its reach.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS h,
    {5 * CELL} + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0) AS n_bytes FROM documents),
p AS (SELECT doc_id, n_bytes, array_to_string(list_transform(range(1, 33), lambda i: lpad(bin(strpos('0123456789abcdef', h[i]) - 1), 4, '0')), '') AS bits FROM d),
t AS (SELECT doc_id, n_bytes, bits, 0 AS depth, sum(n_bytes) OVER () AS b, count(*) OVER () AS r FROM p
    UNION ALL
    SELECT doc_id, n_bytes, bits, depth + 1, sum(n_bytes) OVER (PARTITION BY bits[1:depth + 1]), count(*) OVER (PARTITION BY bits[1:depth + 1]) FROM t WHERE b > {LIMIT} AND r > 1)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, bits[1:depth] AS shard, depth::INTEGER AS depth, b::BIGINT AS shard_bytes, r::BIGINT AS shard_rows FROM t WHERE b <= {LIMIT} OR r = 1"""

ORACLES = {"op7_sharding": ORACLE}
