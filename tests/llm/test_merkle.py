"""The Merkle manifest against a plain tree, and its edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rewardloom.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    out = []
    for value in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        out.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return h(*out)


def tree_of(leaves):
    """Levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, pos, node):
    proof = []
    for level in levels[:-1]:
        run = pos // 8 * 8
        left, right = level[run:pos], level[pos + 1 : run + 8]
        proof += left + right
        node, pos = h(*left, node, *right), pos // 8
    return proof, node


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    out, subs = [], {}
    for lang in by:
        by[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        subs[lang] = tree_of([leaf_of(r, r["text"]) for r in by[lang]])
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    top = tree_of([subs[x][-1][0] for x in order])
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for at, lang in enumerate(order):
        for pos, r in enumerate(by[lang]):
            third = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            text = r["text"].translate(upper) if third and r["text"] is not None else r["text"]
            low, node = walk(subs[lang], pos, leaf_of(r, text))
            high, node = walk(top, at, node)
            out.append((r["doc_id"], subs[lang][0][pos], subs[lang][-1][0], top[-1][0], h(*low, *high), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(1400):
        # One group with three blocks, one of exactly a block, small ones, and a lone leaf.
        lang = "en" if i < 1100 else [None, "", "de", "é"][i % 4] if i < 1399 else "zz"
        text = rng.choice([None, "", "Some Text", "ÄB c", "x" * 3000]) if i % 5 else f"Text {i}"
        out.append((i, rng.choice([None, "a", "B"]), lang, rng.choice([None, i]), text, "own", "own"))
    out += [out[4], out[4], out[7], (None, None, "en", None, None, None, None), (None, "x", "en", 1, "T", None, None)]
    out += [(5000 + i, "s", "block", i, f"T{i}", None, None) for i in range(512)]
    return out


def found(df, tamper=True):
    """The query's columns over any table."""
    out = merkle.verified_against(df, changed={"text": merkle.tampered_text()} if tamper else None)
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256), "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_against_a_plain_tree(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(df) == expected([r.asDict() for r in df.collect()])


def test_order_of_input_does_not_matter(spark, rows):
    df = spark.createDataFrame(rows[1000:], COLUMNS)
    assert found(df.repartition(7)) == found(df.orderBy(F.desc("doc_id")).coalesce(1))


def test_untampered_rows_lead_to_the_root(spark, rows):
    assert all(r[-1] for r in found(spark.createDataFrame(rows[:50], COLUMNS), tamper=False))


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_small_tables(spark, rows, n):
    df = spark.createDataFrame(rows[1100 : 1100 + n], COLUMNS)
    assert found(df) == expected([r.asDict() for r in df.collect()])
    one = df.withColumn("lang", F.lit("en"))
    assert found(one) == expected([r.asDict() for r in one.collect()])


def test_many_equal_rows_are_several_ranges(spark):
    """A row that fills the table is dealt to more than one task."""
    leaves = spark.range(20_000, numPartitions=4).select(F.lit("+en").alias("grp"), F.lit(1).alias("key"), F.lit("d").alias("digest"))
    ordered = leaves.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(8, "grp", "key", "digest", "read")
    assert ordered.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 6_000
    places = merkle.numbered(leaves).agg(F.countDistinct("pos"), F.max("pos"), F.min("size"), F.max("size")).first()
    assert tuple(places) == (20_000, 19_999, 20_000, 20_000)
