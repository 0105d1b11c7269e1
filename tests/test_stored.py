"""Tables stored by sample, and evaluation states: results, plans, hot samples and edges."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from rewardloom.operators.advantage import group_advantage
from rewardloom.operators.evaluate import summarize
from rewardloom.operators.evaluation_state import coarser, merged, read_state, state_of, summary_of, write_state
from rewardloom.operators.rollouts import attach_ground_truth, attach_model_outputs
from rewardloom.sources.copartitioned import _dealt, hot_keys, load, store, with_ground_truth, with_group_advantage, with_model_outputs

BUCKETS = 6


@pytest.fixture()
def no_broadcast(spark):
    """Plans as for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def rollouts(spark):
    """Samples of five rows; one sample with a third of all rows; a NULL sample."""
    id_ = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise((F.col("id") / 5).cast("long"))
    return spark.range(3_000).select(
        id_.cast("long").alias("sample_id"), F.col("id").cast("int").alias("repeat_id"), F.concat(F.lit("text "), "id").alias("response"),
        F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content"))).alias("prompt"), (F.col("id") % 17).cast("double").alias("reward_total"),
    )


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_layout(spark, rollouts, tmp_path):
    stored = store(rollouts, str(tmp_path / "t"), buckets=BUCKETS)
    assert [r[0] for r in stored.keys.collect()] == [7]
    assert stored.even.where("sample_id = 7").isEmpty() and stored.hot.where("sample_id <> 7 OR sample_id IS NULL").isEmpty()
    assert rows(stored.rows(), "*") == rows(rollouts, "*")
    # The hot sample's thousand rows are in all buckets.
    per_file = [r[0] for r in stored.hot.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(per_file) == BUCKETS and max(per_file) < 2 * 1000 / BUCKETS


def test_hot_keys_are_fewer_than_buckets(spark):
    even = spark.range(64).select((F.col("id") % 8).alias("k"))
    assert hot_keys(even, "k", 8).isEmpty() and hot_keys(even, "k", 9).count() == 8
    assert hot_keys(even.limit(0), "k", 8).isEmpty()


def text_moves(plan_text):
    """Whether an exchange moves responses."""
    return any("response" in line for line in re.findall(r"Exchange.*", plan_text))


def test_joins_move_nothing(spark, rollouts, tmp_path, plan, no_broadcast):
    stored = store(rollouts, str(tmp_path / "rollouts"), buckets=BUCKETS)
    samples = rollouts.select("sample_id").distinct().where("sample_id % 4 <> 1").withColumn("answer", F.lit("A"))
    outputs = rollouts.where("repeat_id % 3 < 2").select("sample_id", "repeat_id", (F.col("repeat_id") * 0.5).alias("logit_a"))
    by_sample = store(samples, str(tmp_path / "samples"), within=None, like=stored)
    by_row = store(outputs, str(tmp_path / "outputs"), like=stored)
    again = load(spark, str(tmp_path / "rollouts"))

    found = with_ground_truth(again, by_sample, ["answer"])
    assert rows(found, "sample_id", "repeat_id", "response", "answer") == rows(attach_ground_truth(rollouts, samples, ["answer"]), "sample_id", "repeat_id", "response", "answer")
    # Only the few hot samples' answers are broadcast.
    assert "Exchange hashpartitioning" not in plan(found) and "BroadcastExchange" in plan(found)

    found = with_model_outputs(again, by_row, ["logit_a"])
    assert rows(found, "sample_id", "repeat_id", "response", "logit_a") == rows(attach_model_outputs(rollouts, outputs, ["logit_a"]), "sample_id", "repeat_id", "response", "logit_a")
    assert "Exchange" not in plan(found)

    found = with_group_advantage(again)
    shown = "sample_id", "repeat_id", "response", F.round("advantage", 9).alias("advantage")
    assert rows(found, *shown) == rows(group_advantage(rollouts, "reward_total"), *shown)
    assert not text_moves(plan(found)) and plan(found).count("Exchange hashpartitioning") == 1


def test_layouts_must_agree(spark, rollouts, tmp_path):
    one, two = store(rollouts, str(tmp_path / "a"), buckets=3), store(rollouts, str(tmp_path / "b"), buckets=4)
    with pytest.raises(ValueError, match="different layouts"):
        with_model_outputs(one, two, ["response"])
    with pytest.raises(ValueError, match="buckets"):
        store(rollouts, str(tmp_path / "c"), buckets=5, like=one)


def test_empty_table(spark, rollouts, tmp_path):
    stored = store(rollouts.limit(0), str(tmp_path / "none"), buckets=2)
    assert stored.rows().isEmpty() and with_group_advantage(stored).isEmpty()
    assert stored.rows().columns == rollouts.columns


EVALUATED = (
    "sample_id long, topic string, parsed_successfully boolean, is_correct boolean, confidence_score double, "
    "answer_prob_A double, answer_prob_B double, answer_prob_C double, is_error boolean"
)


@pytest.fixture(scope="module")
def evaluated(spark):
    ids = [5, 5, 6, None, None, -3, 0, 2**40, 32768, 32769, -32768]
    out = []
    for k, i in enumerate(ids * 3):
        p = None if k % 5 == 0 else k / 40
        out.append((i, ["a", "b", None][k % 3], k % 4 > 0, k % 2 == 0, None if k % 3 else k / 33, p, p, p, k % 7 == 0))
    return spark.createDataFrame(out, EVALUATED)


def shown(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("by", [[], ["topic"]])
def test_states_merge_to_the_summary(spark, evaluated, tmp_path, by):
    numbered = evaluated.withColumn("run", F.monotonically_increasing_id() % 4)
    path = str(tmp_path / "states")
    for k in range(4):
        write_state(state_of(numbered.where(F.col("run") == k), ["topic"]), path, f"r{k}")
    found = summary_of(coarser(read_state(spark, path, ["topic"]), by))
    assert found.columns == summarize(evaluated, by=by).columns
    assert shown(found) == shown(summarize(evaluated, by=by))
    # Some of the runs; a compacted state is a state; a run written again replaces itself.
    some = numbered.where("run IN (1, 3)")
    assert shown(summary_of(coarser(read_state(spark, path, ["topic"], ["r1", "r3"]), by))) == shown(summarize(some, by=by))
    two = merged([read_state(spark, path, ["topic"], ["r0", "r1"]), read_state(spark, path, ["topic"], ["r2", "r3"])])
    assert shown(summary_of(coarser(two, by))) == shown(summarize(evaluated, by=by))
    write_state(state_of(numbered.where("run = 2"), ["topic"]), path, "r2")
    assert shown(summary_of(coarser(read_state(spark, path, ["topic"]), by))) == shown(summarize(evaluated, by=by))


def test_state_edges(evaluated):
    with pytest.raises(ValueError, match="no such groups"):
        coarser(state_of(evaluated), ["topic"])
    with pytest.raises(ValueError, match="same groups"):
        merged([state_of(evaluated), state_of(evaluated, ["topic"])])
    nothing = evaluated.limit(0)
    assert shown(summary_of(state_of(nothing))) == shown(summarize(nothing))
    assert shown(summary_of(state_of(nothing, ["topic"]))) == []


def test_rows_travel_packed(spark, rollouts, tmp_path, plan):
    assert not text_moves(plan(_dealt(rollouts, ["sample_id"], BUCKETS, True)))
    store(rollouts, str(tmp_path / "t"), buckets=BUCKETS)
    # A task for each bucket still, and so one file.
    assert len(list((tmp_path / "t" / "even").glob("*.parquet"))) == BUCKETS


def test_packed_rows_come_back_as_they_were(spark, tmp_path):
    df = spark.range(200).selectExpr(
        "CASE WHEN id % 9 <> 0 THEN id % 7 END AS sample_id", "CAST(id AS INT) AS repeat_id", "CASE WHEN id % 5 <> 0 THEN repeat('é ', CAST(id AS INT)) END AS `a text`",
        "CAST(CAST(id AS STRING) AS BINARY) AS b", "id % 3 = 0 AS flag", "CAST(id AS DECIMAL(30, 4)) / 7 AS d", "CASE id % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN -0.0D END AS x",
        "timestamp_seconds(id * 1e8) AS t", "CAST(timestamp_seconds(id) AS timestamp_ntz) AS u", "date_from_unix_date(CAST(id AS INT)) AS day",
        "CASE WHEN id % 2 = 0 THEN array(named_struct('k', id, 'v', CAST(NULL AS STRING))) END AS l", "map('a', id) AS m",
    )
    whole = store(df, str(tmp_path / "whole"), buckets=BUCKETS).rows()
    # NaN is not equal to itself.
    assert whole.dtypes == df.dtypes and repr(rows(whole, "*")) == repr(rows(df, "*"))
    none = store(df.limit(0), str(tmp_path / "none"), buckets=BUCKETS).rows()
    assert none.dtypes == df.dtypes and none.isEmpty()
    # Types that don't pass through Arrow go as they are.
    months = df.selectExpr("sample_id", "repeat_id", "`a text`", "make_ym_interval(0, repeat_id) AS i")
    assert rows(store(months, str(tmp_path / "months"), buckets=BUCKETS).rows().withColumn("i", F.col("i").cast("string")), "*") == rows(months.withColumn("i", F.col("i").cast("string")), "*")
