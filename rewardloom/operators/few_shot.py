"""Few-shot examples: a random sample of the same topic for every test row.

The direct plan joins every test row with every training row of its topic and
keeps a few, which is quadratic in the size of a topic. Here the training rows
of a topic are numbered instead, every test row draws the numbers it wants, and
only those rows are joined. Work is proportional to the rows read plus the
examples returned, whatever the topics' sizes.

Rows are numbered and drawn by topic and id alone. For prompts, test rows of a
topic are gathered in a few parts; a part gets each line that its rows want once,
packed, and puts the prompts together there. A topic may hold a large share of either table, so
no step gathers a topic in one task: training rows are numbered in groups whose
number grows with the topic, and joins with a topic or a wanted row are split
where one is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from rewardloom.operators.prepare import require_columns, require_topic
from rewardloom.operators.prompts import example_line, few_shot_prompt, last_content
from rewardloom.operators.sampling import seeded_key
from rewardloom.options import MAX_CONTEXT_EXAMPLES
from rewardloom.packing import PACKED, pack, packable, unpacked
from rewardloom.scratch import materialize

# Training rows numbered by one task, and positions drawn by one.
ROWS_PER_GROUP = 100_000
DRAWS_PER_TASK = 100_000
# Parts in which prompts are put together: a part takes every line that its rows want once, so few parts move little text. There are as many as
# keep the cluster's cores busy, within these bounds of draws to a part, whose ids are held in memory.
PARTS_PER_CORE = 2
LEAST_PER_PART, DRAWS_PER_PART = 25_000, 4_000_000
# Bytes of prompts that a task passes on at a time, about.
BATCH_BYTES = 2 << 20


def topic_sizes(train: DataFrame, test: DataFrame, topic: str) -> DataFrame:
    """Per topic of both tables: its training rows, its groups and its test rows; written, as several jobs read it."""
    sizes = train.groupBy(topic).agg(F.count(F.lit(1)).alias("topic_size"))
    tests = test.groupBy(topic).agg(F.count(F.lit(1)).alias("tests"))
    groups = F.ceil(F.col("topic_size") / ROWS_PER_GROUP).cast("long")
    return materialize(sizes.join(tests, topic).withColumn("groups", groups), "topics")


def number_within_topic(
    train: DataFrame, topic: str, id_column: str, sizes: DataFrame
) -> DataFrame:
    """Number the rows of each topic from 0, in an order fixed by their ids.

    The rows of a topic are spread over groups by a digest of their id, numbered
    within the group, and shifted by the size of the groups before it. Returns
    topic, id and ``position``.
    """
    digest = F.md5(F.col(id_column).cast("string"))
    # Groups are ranges of the digest: its first 32 bits scaled to the number of groups.
    first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    group = F.shiftright(first * F.col("groups"), 32)
    rows = (
        train.where(F.col(topic).isNotNull())
        .select(topic, id_column)
        .join(sizes.select(topic, "groups"), topic)
        .select(topic, id_column, digest.alias("digest"), group.alias("grp"))
    )
    before = Window.partitionBy(topic).orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        rows.groupBy(topic, "grp")
        .count()
        .withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    in_group = Window.partitionBy(topic, "grp").orderBy("digest", id_column)
    return (
        rows.withColumn("nth", F.row_number().over(in_group) - 1)
        .join(groups, [topic, "grp"])
        .select(topic, id_column, (F.col("start") + F.col("nth")).alias("position"))
    )


def draw_positions(size: Column, cap: int, seed: int, id_column: Column) -> Column:
    """``cap`` distinct positions below ``size``, or all of them if there are no more.

    Robert Floyd's sampling: the i-th of k draws from n picks a number up to
    n - k + i, or n - k + i itself when the pick was drawn before. Every subset
    of k positions is equally likely and nothing of size n is built.
    """

    def draw(drawn: Column, i: Column) -> Column:
        top = size - cap + i
        # 15 hex digits fit a long.
        pick = F.conv(F.substring(seeded_key(seed, id_column, i), 1, 15), 16, 10).cast("long")
        pick = F.pmod(pick, top + 1)
        return F.array_append(drawn, F.when(F.array_contains(drawn, pick), top).otherwise(pick))

    some = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.lit(cap - 1).cast("long")),
        F.array().cast("array<bigint>"),
        draw,
    )
    everything = F.sequence(F.lit(0).cast("long"), size - 1)
    return F.when(size > cap, some).when(size > 0, everything)


def _pairs(
    train: DataFrame, test: DataFrame, topic: str, id_column: str, cap: int, seed: int, parts: bool = False
) -> tuple[DataFrame, int]:
    """``test_id``, ``train_id`` and ``place`` of every pair; with ``parts`` also a part for each test row that has an id, and the number of parts.

    A topic's test rows are in as few parts as its draws are large, one after the other; all rows of a test id are in one part.
    Pairs with parts are read twice, so what was drawn is written.
    """
    known = train.where(F.col(topic).isNotNull())
    test = test.select(F.col(id_column).alias("test_id"), require_topic(F.col(topic)).alias(topic))
    sizes = topic_sizes(known, test, topic)
    numbered = number_within_topic(known, topic, id_column, sizes)

    # Drawing takes far longer than the narrow rows it works on suggest, so the
    # number of tasks follows the number of draws rather than of bytes.
    of_topic = F.col("tests") * F.least(F.col("topic_size"), F.lit(cap))
    draws = sizes.agg(F.sum(of_topic)).first()[0] or 0
    tasks = max(1, -(-draws // DRAWS_PER_TASK))
    positions = draw_positions(F.col("topic_size"), cap, seed, F.col("test_id"))
    drawing = test.join(sizes.select(topic, "topic_size", of_topic.alias("draws")), topic).repartition(tasks, "test_id")
    part, count = [], 1
    if parts:
        share = -(-draws // (PARTS_PER_CORE * train.sparkSession.sparkContext.defaultParallelism))
        most = max(1, min(DRAWS_PER_PART, max(LEAST_PER_PART, share)))
        count = max(1, -(-draws // most))
        span = F.ceil(F.col("draws") / most)
        home = F.min(F.struct(F.col(topic).alias("topic"), span.alias("span"))).over(Window.partitionBy("test_id"))
        nth = F.hash("home.topic").cast("long") + F.pmod(F.xxhash64("test_id"), F.col("home.span"))
        drawing = drawing.where("test_id IS NOT NULL").withColumn("home", home).withColumn("part", F.pmod(nth, F.lit(count)).cast("int"))
        part = ["part"]
    wanted = drawing.select(topic, "topic_size", "test_id", *part, F.explode(positions).alias("position"))
    if parts:
        wanted = materialize(wanted, "drawn")
    place = F.when(
        F.col("topic_size") > cap, seeded_key(seed, F.col("test_id"), F.col(id_column))
    ).otherwise("")
    # Spark takes the drawn positions for as many as the test rows they come from and would broadcast them all.
    pairs = wanted.hint("merge").join(numbered, [topic, "position"]).select(
        "test_id", F.col(id_column).alias("train_id"), place.alias("place"), *part
    )
    return pairs, count


def sample_examples(
    train: DataFrame,
    test: DataFrame,
    *,
    topic: str = "topic",
    id_column: str = "row_id",
    cap: int = MAX_CONTEXT_EXAMPLES,
    seed: int = 42,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Pairs of a test row and a training row of its topic, at most ``cap`` each.

    Columns: ``test_id``, ``train_id``, the training columns to ``carry`` and
    ``place``, a key to sort a test row's examples by (then by ``train_id``):
    blank when the whole topic is used, so that it stays in order, and
    pseudo-random when it is sampled.
    """
    pairs, _ = _pairs(train, test, topic, id_column, cap, seed)
    if not carry:
        return pairs
    carried = train.select(
        F.col(id_column).alias("train_id"), *[column.alias(name) for name, column in carry.items()]
    )
    return pairs.join(carried, "train_id").select("test_id", "train_id", "place", *carry)


def _assemble(batches):
    """The test rows of a part with ``_context``, their examples' lines, and ``_count``.

    Lines are kept in a file of the task, compressed one by one, and read where a row wants them; the rows are kept packed.
    """
    import os
    import tempfile
    from array import array

    import numpy as np
    import pyarrow as pa

    codec = pa.Codec("lz4_raw")
    folders = [x for x in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(x)]
    first, others, held = {}, {}, []
    starts, sizes, end = array("q", [0]), array("q"), 0
    with tempfile.TemporaryFile(dir=folders[os.getpid() % len(folders)] if folders else None) as file:
        for batch in batches:
            for is_row, value in zip(batch.column("is_row").to_pylist(), batch.column("rows"), strict=True):
                if is_row:
                    held.append(pa.scalar(value.as_py(), pa.binary()))
                    continue
                for lines in unpacked(value):
                    for key, line in zip(lines.column(0).to_pylist(), lines.column(1), strict=True):
                        number, line = len(sizes), line.as_buffer() if line.is_valid else None
                        if first.setdefault(key, number) != number:
                            others.setdefault(key, []).append(number)
                        if line is not None:
                            end += file.write(codec.compress(line, asbytes=True))
                        sizes.append(-1 if line is None else line.size)
                        starts.append(end)
        file.flush()
        at = file.fileno()

        def line_of(number):
            if sizes[number] < 0:
                return None
            return codec.decompress(os.pread(at, starts[number + 1] - starts[number], starts[number]), sizes[number], asbytes=True)

        def lines_of(keys):
            found = []
            for i, key in enumerate(keys):
                if key not in others:
                    found.append(line_of(first[key]))
                elif not i or keys[i - 1] != key:
                    # The rows of one id, by their lines.
                    each = sorted(map(line_of, [first[key], *others[key]]), key=lambda x: (x is not None, x or b""))
                    times = next((j for j in range(i, len(keys)) if keys[j] != key), len(keys)) - i
                    found += [x for x in each for _ in range(times)]
            return found

        for value in held:
            for rows in unpacked(value):
                wanted, begin, size, contexts, counts = rows.column("_examples").to_pylist(), 0, 0, [], []
                for i, keys in enumerate(wanted, 1):
                    found = lines_of(keys or [])
                    contexts.append(b"\n\n".join(x for x in found if x is not None))
                    counts.append(len(found))
                    size += len(contexts[-1])
                    if size >= BATCH_BYTES or i == len(wanted):
                        some = rows.slice(begin, i - begin).drop_columns(["_examples"])
                        ends = np.cumsum([0, *map(len, contexts)], dtype=np.int32)
                        new = [pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(contexts))), pa.array(counts, pa.int32())]
                        yield pa.RecordBatch.from_arrays([*some.columns, *new], [*some.schema.names, "_context", "_count"])
                        begin, size, contexts, counts = i, 0, [], []


def few_shot_prompts(
    train: DataFrame,
    test: DataFrame,
    *,
    topic: str = "topic",
    id_column: str = "row_id",
    cap: int = MAX_CONTEXT_EXAMPLES,
    seed: int = 42,
) -> DataFrame:
    """Add ``full_prompt`` and ``context_examples_count`` to the test rows.

    Both tables have ``prompt`` and ``answers``. Test rows of a topic without
    training rows stay, with no examples.
    """
    for table, name in ((train, "the training table"), (test, "the test table")):
        require_columns(table, [topic, id_column, "prompt", "answers"], name)
    pairs, parts = _pairs(train, test, topic, id_column, cap, seed, parts=True)
    # The order of hexadecimal digits is that of their bytes.
    pairs = pairs.where("train_id IS NOT NULL").withColumn("place", F.unhex("place"))
    # At most cap ids per test row are collected.
    contexts = (
        pairs.groupBy(F.col("test_id").alias(id_column), F.col("part").alias("_part"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "train_id"))).alias("_examples"))
        .withColumn("_examples", F.col("_examples")["train_id"])
    )
    carried = all(packable(f.dataType) for f in test.schema)
    rows = (test if carried else test.select(id_column, "prompt").where(F.col(id_column).isNotNull()).dropDuplicates([id_column])).join(contexts, id_column, "left")
    # Rows without examples go anywhere.
    part = F.coalesce("_part", F.pmod(F.xxhash64(id_column, last_content(F.col("prompt"))), F.lit(parts)).cast("int"))
    rows = rows.select(part.alias("_part"), *rows.drop("_part").columns)
    schema = StructType([*rows.drop("_part", "_examples").schema, StructField("_context", StringType()), StructField("_count", IntegerType())])
    # Each part gets a line once, whatever the number of rows there that want it.
    lines = train.select(F.col(id_column).alias("train_id"), example_line(train).cast("binary").alias("line"))
    lines = pairs.select("part", "train_id").distinct().join(lines, "train_id").select("part", "train_id", "line")
    packed = rows.mapInArrow(pack, PACKED).withColumn("is_row", F.lit(True)).unionByName(
        lines.mapInArrow(pack, PACKED).withColumn("is_row", F.lit(False))
    )
    found = packed.repartitionById(parts, "bucket").mapInArrow(_assemble, schema)
    if not carried:
        found = test.join(found.drop("prompt"), id_column, "left")
    return found.withColumns(
        {
            "full_prompt": few_shot_prompt(F.array(F.coalesce("_context", F.lit(""))), last_content(F.col("prompt"))),
            "context_examples_count": F.coalesce("_count", F.lit(0)),
        }
    ).drop("_context", "_count")
