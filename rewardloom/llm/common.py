"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.scratch import discard, materialize

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: DuckDB's expression for the words of a text, A-Z lower-cased.
WORDS_SQL = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x20\x09-\x0D]+'), lambda x: x <> '')"
)


#: Edges that a task merges at a time.
EDGES_PER_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, name: str) -> str | None:
    """The column that Spark takes for ``name``, whatever its case; None if there is none."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    found = [c for c in df.columns if c == name or not sensitive and c.lower() == name.lower()]
    if len(found) > 1:
        raise ValueError(f"several columns may be {name}: {', '.join(found)}")
    return found[0] if found else None


def column(df: DataFrame, name: str, kind: str, needed: bool = True) -> Column:
    """``name`` as ``kind``. Without such a column it is an error, or NULL where it isn't ``needed``."""
    found = named(df, name)
    if found is None and needed:
        raise ValueError(f"no column {name} among {', '.join(df.columns)}")
    return (F.lit(None) if found is None else F.col(f"`{found}`")).cast(kind)


def unused(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` where ``df`` has one of the columns that are to be added."""
    if clash := [name for name in names if named(df, name)]:
        raise ValueError(f"columns {clash} are in the table already")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def stars(a, b):
    """(node, label): the smallest node reachable from each node of the edges in two arrays."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        # Both ends' labels point to the smaller one, and every node to where its label ends.
        ends, low = (label[x], label[y]), np.minimum(label[x], label[y])
        for end in ends:
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def _merged(edges: DataFrame, n_tasks: int) -> DataFrame:
    """(a, b): each node of a run of ``EDGES_PER_TASK`` edges, and the smallest node that it reaches within the run."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def found(parts):
            a, b = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("a", "b"))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], ["a", "b"])

        parts, n = [], 0
        for batch in batches:
            if parts and n + batch.num_rows > EDGES_PER_TASK:
                yield found(parts)
                parts, n = [], 0
            parts.append(batch)
            n += batch.num_rows
        if n:
            yield found(parts)

    return edges.coalesce(n_tasks).mapInArrow(run, "a long, b long")


def smallest_labels(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``edges`` (a, b).

    Each round first has tasks merge runs of a bounded number of edges; edges that are one run are settled by that. Else
    it replaces an edge's ends by what they point to: first every node
    hangs its larger neighbours under its smallest one, then every node hangs its
    smaller neighbours under the smallest of them. Long chains halve, a hub's edges are aggregated
    before they are shuffled, and each round's edges are written, so nothing is
    collected but a count.
    """
    edges = materialize(
        edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct(), "edges"
    )
    for _ in range(rounds):
        n_tasks = max(1, -(-edges.count() // EDGES_PER_TASK))
        merged = materialize(_merged(edges, n_tasks), "labels")
        discard(edges)
        if n_tasks == 1:
            return merged.select(F.col("a").alias("node"), F.col("b").alias("label"))
        edges = merged.where("a <> b")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the rows of a hub are split in the join.
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # The node itself also hangs under its smallest neighbour.
        large = large.unionByName(low.where("a <> m").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = materialize(large, "edges")
        discard(merged, low)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialize(small, "edges")
        discard(large, low)
        # Done when every node hangs under a root directly: no node is above and below an edge.
        if edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            deep = edges.groupBy("a").count().where("count > 1").isEmpty()
            if deep:
                roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
                return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
    raise RuntimeError(f"components not settled after {rounds} rounds")
