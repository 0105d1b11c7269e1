"""Columns by any case, missing and clashing ones, and limits that no size switches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rewardloom.llm import editing, jaccard, quality, secrets, sharding, urls
from rewardloom.llm.common import column, named, unused

GOOD = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="module")
def upper(spark):
    """Documents whose columns are written in other cases, with columns the operators use inside."""
    rows = [(1, GOOD + " password=b7db7aa4a5fcc78305", "en", "a", 1, 2, "x"), (2, None, None, None, 3, 4, "y"), (3, GOOD + " password=b7db7aa4a5fcc78305", "en", "a", 1, 2, "z")]
    return spark.createDataFrame(rows, "doc_id long, TEXT string, Lang string, SOURCE string, RID long, Digest long, component string")


def test_columns_as_spark_finds_them(spark, upper):
    assert named(upper, "text") == "TEXT" and named(upper, "other") is None
    assert {r[0] for r in quality.keep_good(upper).select("doc_id").collect()} == {1, 3}
    assert quality.keep_good(upper).columns == upper.columns
    assert secrets.redacted(upper).columns == upper.columns
    assert [("[secret]" in (r["TEXT"] or "")) for r in secrets.redacted(upper).orderBy("doc_id").collect()] == [True, False, True]
    kept = jaccard.one_of_each(upper)
    assert kept.columns == upper.columns and {r["doc_id"] for r in kept.collect()} == {1, 2}
    assert sharding.assign(upper, 150).select("doc_id", "TEXT", "shard").count() == 3


def test_a_missing_text_is_an_error(spark, upper):
    without = upper.drop("TEXT")
    for broken in (lambda: quality.keep_good(without), lambda: secrets.redacted(without), lambda: sharding.assign(without), lambda: urls.judged(without, key="doc_id")):
        with pytest.raises(ValueError, match="no column"):
            broken()
    with pytest.raises(ValueError, match="no column b"):
        column(spark.range(1), "b", "string")
    # Groups may lack: all documents are one then.
    assert quality.keep_good(upper.drop("Lang", "SOURCE")).count() == 2


def test_clashing_columns_are_errors(spark, upper):
    docs = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, n_reencoded long").withColumn("edits", F.array().cast(editing.EDITS))
    with pytest.raises(ValueError, match="in the table already"):
        editing.updated(editing.counted(docs))
    with pytest.raises(ValueError, match="in the table already"):
        editing.counted(upper.withColumn("State", F.lit(1)), text="TEXT")
    with pytest.raises(ValueError, match="in the table already"):
        sharding.assign(upper.withColumn("SHARD", F.lit(1)))
    unused(upper, "something")
    both = editing.updated(editing.counted(docs.drop("n_reencoded")))
    assert both.select("n_tokens", "n_reencoded").count() == 1


def test_shards_count_all_they_write(spark):
    """Rows without text, wide other columns and nested values fill shards too."""
    rows = [(i, None if i % 2 else "", "s" * 100, [f"t{k}" for k in range(i % 5)], None if i % 3 else b"x" * 50) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tags array<string>, raw binary")
    placed = sharding.assign(df, 5_000).collect()
    size = lambda r: 5 * sharding.CELL + 100 + len("[" + ",".join(f'"{t}"' for t in r["tags"]) + "]") + len(r["raw"] or b"")
    assert all(r["n_bytes"] == size(r) for r in placed)
    sums = {}
    for r in placed:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["n_bytes"]
    assert len(sums) > 5 and max(sums.values()) <= 5_000 and all(sums[r["shard"]] == r["shard_bytes"] for r in placed)


def test_cutoffs_change_little_with_a_row(spark):
    """A group's cutoffs go from the wider group's to its own step by step: a row more or less moves them by little, whatever the group's size."""

    def limits(n):
        plain, marked = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}##" for i in range(40))
        rows = [(i, plain + f" {i}", "en", "prose") for i in range(3_000)] + [(5000 + i, marked + f" {i}", "en", "code") for i in range(n)]
        docs = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
        found = quality.cutoffs(quality.sketches(docs), quality.Rules()).where("g_source = 'code'").first()
        return found["symbols_hi"]

    steps = {n: limits(n) for n in (1, 2, 30, 31, 49, 50, 51, 120, 121)}
    assert steps[1] < steps[30] < steps[50] < steps[120]
    whole = steps[120] - steps[1]
    assert all(abs(steps[n + 1] - steps[n]) < 0.1 * whole for n in (1, 30, 49, 50, 120))


def test_words_of_any_length(spark):
    """Long words are counted and found in names."""
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    pages = spark.createDataFrame([(1, f"http://{long}blog.org/a", f"<p>{long} blog {long}</p>"), (2, None, None)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in urls.judged(pages).collect()}
    assert found[1]["host_words"][:2] == [long, "blog"] and found[2]["host"] == ""
