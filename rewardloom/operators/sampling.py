"""Exact, seeded samples that do not depend on how the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows are counted in 16**4 groups at a time, the most the driver receives.
DIGITS = 4
DIGEST_LENGTH = 32


def seeded_key(seed: int, *columns: Column) -> Column:
    """A pseudo-random 128-bit key per row, fixed by the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def exact_fraction(
    df: DataFrame, fraction: float, seed: int, id_column: str = "row_id"
) -> DataFrame:
    """A random ``int(n * fraction)`` of the n rows, the same ones for a seed.

    These are the rows with the smallest seeded keys. The largest key among
    them is found by counting rows per key prefix, then per longer prefix within
    the group where the count is reached; each count reads the id column only.
    What is left is a filter on one row at a time: the sample itself needs no
    sort and no shuffle.

    ``id_column`` must be unique. The table is read once for each count, so a
    costly one should be written first (``rewardloom.scratch.materialize``).
    """
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"the fraction must be above 0.0 and at most 1.0, got {fraction}")
    key = seeded_key(seed, F.col(id_column))
    keys = df.select(key.alias("key"), F.col(id_column).alias("id"))

    prefix, wanted = "", None
    while wanted is None or len(prefix) < DIGEST_LENGTH:
        group = F.substring("key", len(prefix) + 1, DIGITS)
        counts = (
            keys.where(F.startswith("key", F.lit(prefix)))
            .groupBy(group.alias("group"))
            .count()
            .orderBy("group")
            .collect()
        )
        if wanted is None:
            wanted = int(sum(row["count"] for row in counts) * fraction)
            if wanted == 0:
                return df.limit(0)
        for row in counts:
            if wanted <= row["count"]:
                break
            wanted -= row["count"]
        prefix += row["group"]
        if wanted == row["count"]:
            # The whole group belongs to the sample.
            return df.where(F.substring(key, 1, len(prefix)) <= prefix)

    # The digest is used up: rows with this very key are told apart by id.
    last = (
        keys.where(F.col("key") == prefix).select("id").orderBy("id").limit(wanted).agg(F.max("id").alias("id")).first()["id"]
    )
    return df.where((key < prefix) | ((key == prefix) & (F.col(id_column) <= F.lit(last))))


#: Rows of a key range, about; the most hexadecimal digits that ranges are told apart by.
RANGE_ROWS, MOST_DIGITS = 50_000, 8
#: Ranges that are few enough to be sent to all tasks: 16**4 rows of two short columns.
BROADCAST_DIGITS = 4


def in_sample_order(
    df: DataFrame, seed: int, id_column: str = "row_id", position: str = "position"
) -> DataFrame:
    """Add ``position``: each row's place, from 0 and without gaps, in the seeded random order that ``exact_fraction`` takes the first rows of.

    No global sort and no sampling of the table: keys are digests, so the ranges that share their first digits are alike in size. Rows are
    counted per range (the id column alone is read), running sums over the counts give where each range begins, and rows are ranked within their range, in one
    shuffle. Rows with one id, in any order, follow one another; a NULL id counts as a value.
    """
    if position in df.columns:
        raise ValueError(f"the table has a column {position} already")
    key = seeded_key(seed, F.coalesce(F.col(id_column).cast("string"), F.lit("NULL")))
    total, digits = df.select(id_column).count(), 1
    while digits < MOST_DIGITS and total > RANGE_ROWS * 16**digits:
        digits += 1
    # Sums run within the ranges that share half of their digits, then over these.
    upper = digits // 2
    counts = df.groupBy(F.substring(key, 1, digits).alias("_range")).agg(F.count(F.lit(1)).alias("n")).withColumn("_upper", F.substring("_range", 1, upper))
    sums = counts.groupBy("_upper").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    first = sums.select("_upper", F.coalesce(F.sum("n").over(before.orderBy("_upper")), none).alias("_first"))
    within = F.coalesce(F.sum("n").over(before.partitionBy("_upper").orderBy("_range")), none)
    starts = counts.withColumn("_within", within).join(first, "_upper").select("_range", (F.col("_first") + F.col("_within")).alias("_start"))
    if digits <= BROADCAST_DIGITS:
        starts = F.broadcast(starts)
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key", id_column)) - 1
    keyed = df.withColumns({"_key": key, "_range": F.substring(key, 1, digits)}).withColumn("_place", place)
    return keyed.join(starts, "_range").withColumn(position, F.col("_start") + F.col("_place")).drop("_key", "_range", "_start", "_place")
