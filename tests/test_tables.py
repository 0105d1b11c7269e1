"""Preparation, sampling, few-shot examples, evaluation and report tables."""

import collections
import hashlib
import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rewardloom.operators.advantage import group_advantage, reward_report
from rewardloom.operators.evaluate import (
    evaluate_few_shot,
    evaluate_responses,
    few_shot_metrics,
    result_metrics,
    result_rows,
    sample_table,
    summarize,
)
from rewardloom.operators.few_shot import few_shot_prompts, number_within_topic, sample_examples, topic_sizes
from rewardloom.operators.prepare import keep_filled, keep_first
from rewardloom.operators.prompts import add_prompts, last_content
from rewardloom.operators.responses import ChatTemplate, equal_pairs, tagged_response
from rewardloom.operators.rollouts import attach_model_outputs, expand_repeats, option_probabilities
from rewardloom.operators.sampling import exact_fraction, in_sample_order, seeded_key
from rewardloom.options import DatasetOptions, Options, TwoStageColumns, merge
from rewardloom.plans.preparation import prepare
from rewardloom.plans.training import build_training_tables


# ------------------------------------------------------------- preparation


def test_keep_first(spark):
    rows = [(5, "a"), (2, "a"), (3, None), (4, None), (1, "A"), (6, ""), (7, "a ")]
    df = spark.createDataFrame(rows, "row_id long, question string").repartition(4)
    kept = keep_first(df, "question")
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 2, 3, 6, 7]
    assert keep_first(kept, "question").count() == kept.count()
    assert keep_first(df, "no such column") is df


def test_keep_first_with_a_hot_value(spark):
    df = spark.range(30_000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("question"),
    )
    kept = keep_first(df, "question")
    assert kept.count() == 20_001
    assert kept.where("question = 'hot'").first()["row_id"] == 1


@pytest.mark.parametrize("fraction", [0.001, 0.3, 0.5, 0.999, 1.0])
def test_exact_fraction(spark, fraction):
    df = spark.range(7_777).withColumnRenamed("id", "row_id")
    sample = {r["row_id"] for r in exact_fraction(df, fraction, 7).collect()}
    assert len(sample) == int(7_777 * fraction)
    keys = df.select("row_id", seeded_key(7, F.col("row_id")).alias("key")).collect()
    ordered = [r["row_id"] for r in sorted(keys, key=lambda r: (r["key"], r["row_id"]))]
    assert sample == set(ordered[: len(sample)])
    again = exact_fraction(df.repartition(13), fraction, 7)
    assert {r["row_id"] for r in again.collect()} == sample


def test_exact_fraction_descends_into_large_groups(spark, monkeypatch):
    """With one digit at a time, groups stay large and the count goes deeper."""
    from rewardloom.operators import sampling

    monkeypatch.setattr(sampling, "DIGITS", 1)
    df = spark.range(5_000).withColumnRenamed("id", "row_id")
    for fraction in (0.2, 0.37, 0.9, 1.0):
        sample = {r["row_id"] for r in exact_fraction(df, fraction, 1).collect()}
        keys = df.select("row_id", seeded_key(1, F.col("row_id")).alias("key")).collect()
        ordered = [r["row_id"] for r in sorted(keys, key=lambda r: (r["key"], r["row_id"]))]
        assert sample == set(ordered[: int(5_000 * fraction)])


def test_exact_fraction_with_equal_keys(spark, monkeypatch):
    """Where the digest is used up, ids decide."""
    from rewardloom.operators import sampling

    monkeypatch.setattr(sampling, "seeded_key", lambda seed, *columns: F.lit("0" * 32))
    df = spark.range(100).withColumnRenamed("id", "row_id")
    assert {r["row_id"] for r in exact_fraction(df, 0.37, 1).collect()} == set(range(37))


def test_hot_group_is_split(spark):
    """The statistics' join is split where one group holds most rows."""
    from rewardloom.operators.advantage import group_advantage

    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(400_000, numPartitions=8).select(
            F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5_000).alias("sample_id"), F.rand(1).alias("reward_total")
        )
        scored = group_advantage(rows)
        scored.write.format("noop").mode("overwrite").save()
        scored.count()
        joined = scored.agg(F.sum("advantage"))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_missing_samples_keep_their_rollouts(spark):
    from rewardloom.operators.rollouts import attach_ground_truth

    rollouts = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "sample_id long, response string")
    samples = spark.createDataFrame([(1, "A")], "sample_id long, answers string")
    found = {(r["sample_id"], r["answers"]) for r in attach_ground_truth(rollouts, samples, ["answers"]).collect()}
    assert found == {(1, "A"), (2, None), (None, None)}


def test_filled_takes_any_type(spark):
    from rewardloom.operators.prepare import keep_filled, without_topic

    df = spark.createDataFrame([(1, 0, "x"), (2, None, "y"), (3, 5, ""), (4, 6, None)], "i int, n long, s string")
    assert [r["i"] for r in keep_filled(df, "n").collect()] == [1, 3, 4]
    assert [r["i"] for r in keep_filled(df, "n", "s").collect()] == [1]
    assert [r["i"] for r in without_topic(df, "s").collect()] == [3, 4]


def test_no_rewards_is_an_error(spark):
    from rewardloom.plans.scoring import score_rollouts
    from rewardloom.rewards.content import language

    with pytest.raises(ValueError, match="no reward functions"):
        score_rollouts(spark.range(1), [])
    with pytest.raises(ValueError, match="no function words"):
        language("it")
    language("it", detected_column="lang")


def test_exact_fraction_limits(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    for fraction in (0.0, -0.1, 1.1):
        with pytest.raises(ValueError):
            exact_fraction(df, fraction, 1)
    assert exact_fraction(df, 0.05, 1).count() == 0
    assert exact_fraction(df.limit(0), 0.5, 1).count() == 0


@pytest.mark.parametrize("range_rows", [50_000, 30, 1])
def test_sample_order(spark, monkeypatch, plan, range_rows):
    """Dense positions in the order of keys, whatever the number of ranges; the exact sample is its beginning."""
    from rewardloom.operators import sampling

    monkeypatch.setattr(sampling, "RANGE_ROWS", range_rows)
    df = spark.range(700).withColumnRenamed("id", "row_id").withColumn("text", F.lit("t"))
    found = in_sample_order(df, 1)
    assert "rangepartitioning" not in plan(found)
    rows = found.orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(700))
    keys = df.orderBy(seeded_key(1, F.col("row_id"))).select("row_id").collect()
    assert [r["row_id"] for r in rows] == [r["row_id"] for r in keys]
    assert {r["row_id"] for r in exact_fraction(df, 0.1, 1).collect()} == {r["row_id"] for r in rows[:70]}
    repeated = spark.createDataFrame([(1,), (1,), (None,), (None,)], "row_id long")
    assert sorted(r["position"] for r in in_sample_order(repeated, 1).collect()) == [0, 1, 2, 3]
    assert in_sample_order(df.limit(0), 1).isEmpty()
    with pytest.raises(ValueError, match="already"):
        in_sample_order(df.withColumn("position", F.lit(1)), 1)


def test_option_tokens(spark):
    from rewardloom.operators.option_tokens import log_probability, probabilities_of_likeliest, spellings

    assert spellings({"A": 3, "ĠA": 1, "B": 2, "▁C": 9, "C</w>": 4, "D": 5}) == {"A": [1, 3], "B": [2], "C": [4, 9]}
    with pytest.raises(ValueError, match="no token for C"):
        spellings({"A": 3, "B": 2})
    rows = [({1: -1.0, 3: -2.0, 2: -700.0},), ({2: -1.0},), ({},), (None,)]
    df = spark.createDataFrame(rows, "top map<int,double>")
    got = [r[0] for r in df.select(log_probability(F.col("top"), [1, 3])).collect()]
    assert got[0] == pytest.approx(math.log(math.exp(-1) + math.exp(-2))) and got[1:] == [None, None, None]
    found = df.select(*probabilities_of_likeliest(F.col("top"), {"A": [1, 3], "B": [2]}).values()).collect()
    assert tuple(found[0]) == pytest.approx((1.0, 0.0)) and {tuple(r) for r in found[1:]} == {(0.333, 0.333)}


def test_different_seeds_give_different_samples(spark):
    df = spark.range(1_000).withColumnRenamed("id", "row_id")
    a, b = ({r["row_id"] for r in exact_fraction(df, 0.5, seed).collect()} for seed in (1, 2))
    assert 150 < len(a & b) < 350


def test_keep_filled_counts(spark):
    df = spark.createDataFrame([("x", "y"), ("", "y"), (None, "y"), ("x", None)], "a string, b string")
    seen = Observation("filter")
    assert keep_filled(df, "a", "b", observation=seen).count() == 1
    assert seen.get == {"rows_before": 4, "rows_after": 1}


def test_prepare_order(spark):
    rows = [(i, f"q{i % 50}", "A") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, question string, answer string")
    options = Options(dataset=DatasetOptions(subset_fraction=0.5))
    train, test = prepare(df, df, options)
    assert (train.count(), test.count()) == (25, 50)
    train, test = prepare(df, df, options, dedup=False)
    assert (train.count(), test.count()) == (50, 100)


def test_prompts(spark):
    df = spark.createDataFrame([("q", "A", "r"), ("q", "A", ""), ("q", "A", None)], "question string, answer string, why string")
    dataset = DatasetOptions(system_prompt="s", reasoning_column="why")
    rows = add_prompts(df, dataset).select(
        "answer_only", F.size("prompt").alias("n"), last_content(F.col("prompt")).alias("last")
    ).collect()
    assert [tuple(r) for r in rows] == [(True, 3, "r"), (True, 3, ""), (False, 2, "q")]


# --------------------------------------------------------------- responses


RESPONSE_SCHEMA = "answer string, sft string, dpo string, think1 string, confidence int, think2 string, a string, b string"


def response(spark, row, **settings):
    df = spark.createDataFrame([row], RESPONSE_SCHEMA)
    dataset = DatasetOptions(sft_column="sft", dpo_comment_column="dpo", **settings)
    return df.select(tagged_response(df, dataset, settings.pop("instead", None)).alias("r")).first()["r"]


def test_layouts(spark):
    full = ("A", "why", "no", "t1", 60, "t2", "x", "y")
    stages, steps = TwoStageColumns(), {"one": "a", "two": "b", "three": "missing"}
    assert response(spark, full) == "<reasoning>why</reasoning><answer>A</answer>"
    assert response(spark, full, reasoning_tag_name="r") == "<r>why</r><answer>A</answer>"
    staged = "<think>t1</think><confidence>60</confidence><think>t2</think><answer>A</answer>"
    assert response(spark, full, two_stage_reasoning=stages, multistep_reasoning_columns=steps) == staged
    stepped = "<one>x</one><two>y</two><answer>A</answer>"
    assert response(spark, full, multistep_reasoning_columns=steps) == stepped
    # A confidence of 0 or an empty thought leaves the two-stage layout unfilled.
    for part in (("t1", 0, "t2"), ("", 60, "t2"), ("t1", 60, None)):
        row = ("A", "why", "no", *part, "", "y")
        assert response(spark, row, two_stage_reasoning=stages, multistep_reasoning_columns=steps) == "<two>y</two><answer>A</answer>"
    empty = ("A", None, "no", None, None, None, "", None)
    assert response(spark, empty, two_stage_reasoning=stages, multistep_reasoning_columns=steps) == "<reasoning>None</reasoning><answer>A</answer>"
    missing = DatasetOptions(sft_column="sft", two_stage_reasoning=TwoStageColumns(think1_column="missing"))
    df = spark.createDataFrame([full], RESPONSE_SCHEMA)
    assert df.select(tagged_response(df, missing)).first()[0] == "<reasoning>why</reasoning><answer>A</answer>"


def test_preference_pairs_and_methods(spark):
    schema = "row_id long, question string, " + RESPONSE_SCHEMA.replace("dpo ", "dpo_comment ")
    rows = [(1, "q", "A", "good", "bad", "t1", 1, "t2", "", ""), (2, "q", "A", "good", "", "t1", 1, "t2", "", ""),
            (3, "q", "A", "", "bad", "t1", 1, "t2", "", "")]
    df = spark.createDataFrame(rows, schema)
    options = Options(dataset=DatasetOptions(sft_column="sft"))
    pairs = build_training_tables(df, df, options)["pairs"]
    assert [(r["chosen"], r["rejected"]) for r in pairs.collect()] == [
        ("<reasoning>good</reasoning><answer>A</answer>", "<reasoning>bad</reasoning><answer>A</answer>")
    ]
    # The two-stage layout does not read the training column.
    staged = Options(dataset=DatasetOptions(sft_column="sft", two_stage_reasoning=TwoStageColumns()))
    assert build_training_tables(df, df, staged)["pairs"].agg(equal_pairs()).first()[0] == 1
    tables = build_training_tables(df, df, options, "sft_dpo", ChatTemplate(start="^"))
    assert {k: v.count() for k, v in tables.items()} == {"texts": 2, "pairs": 1}
    assert tables["texts"].columns == ["text"]
    assert tables["texts"].first()["text"] == (
        "^<|system|>\n\n<|user|>\nq\n<|assistant|>\n<reasoning>good</reasoning><answer>A</answer>\n"
    )
    with pytest.raises(ValueError, match="unknown method"):
        build_training_tables(df, df, options, "ppo")
    with pytest.raises(ValueError, match="sft_column"):
        build_training_tables(df, df, Options(), "sft")
    with pytest.raises(ValueError, match="dpo_comment"):
        build_training_tables(df.drop("dpo_comment"), df, options, "dpo")


# ---------------------------------------------------------------- few-shot


def topic_table(spark, sizes, start=0):
    rows = [(t, k) for t, n in sizes.items() for k in range(n)]
    rows = [(start + i, t, f"q{i}", "A") for i, (t, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "row_id long, topic string, question string, answer string")
    return add_prompts(df, DatasetOptions())


def test_numbering_is_dense(spark):
    train = topic_table(spark, {"hot": 5_000, "b": 3, "c": 1})
    found = collections.defaultdict(list)
    sizes = topic_sizes(train, train, "topic")
    for r in number_within_topic(train, "topic", "row_id", sizes).collect():
        found[r["topic"]].append(r["position"])
    assert {t: sorted(p) == list(range(len(p))) for t, p in found.items()} == {"hot": True, "b": True, "c": True}


def test_examples_per_test_row(spark):
    train = topic_table(spark, {"hot": 500, "exact": 80, "few": 3})
    test = topic_table(spark, {"hot": 40, "exact": 5, "few": 5, "unseen": 2}, start=10_000)
    pairs = sample_examples(train, test, seed=3)
    by_test = collections.defaultdict(list)
    for r in pairs.collect():
        by_test[r["test_id"]].append(r["train_id"])
    topics = {r["row_id"]: r["topic"] for r in train.unionByName(test).collect()}
    sizes = collections.Counter()
    for test_id, train_ids in by_test.items():
        assert len(set(train_ids)) == len(train_ids)
        assert {topics[i] for i in train_ids} == {topics[test_id]}
        sizes[topics[test_id], len(train_ids)] += 1
    assert sizes == {("hot", 80): 40, ("exact", 80): 5, ("few", 3): 5}
    assert len({tuple(sorted(v)) for k, v in by_test.items() if topics[k] == "hot"}) == 40
    repartitioned = sample_examples(train.repartition(7), test.repartition(3), seed=3)
    assert sorted(map(tuple, repartitioned.collect())) == sorted(map(tuple, pairs.collect()))


def test_groups_change_nothing(spark, monkeypatch):
    """Topics numbered in many groups and drawn in many tasks give the same examples."""
    from rewardloom.operators import few_shot

    train, test = topic_table(spark, {"t": 900, "one": 1}), topic_table(spark, {"t": 50, "one": 50}, start=1_000)
    expected = sorted(map(tuple, sample_examples(train, test).collect()))
    assert len(expected) == 50 * 80 + 50
    monkeypatch.setattr(few_shot, "ROWS_PER_GROUP", 7)
    monkeypatch.setattr(few_shot, "DRAWS_PER_TASK", 100)
    groups = {r["topic"]: r["groups"] for r in few_shot.topic_sizes(train, test, "topic").collect()}
    assert groups == {"t": 129, "one": 1}
    assert sorted(map(tuple, sample_examples(train, test).collect())) == expected


def test_examples_carry_no_text_through_windows(spark):
    """Numbering and drawing work on ids: the text is joined at the end."""
    import re

    train, test = topic_table(spark, {"t": 90}), topic_table(spark, {"t": 5}, start=1_000)
    plans = []
    for rows in (train, topic_table(spark, {"t": 990})):
        prompts = few_shot_prompts(rows, test)
        plan = prompts._jdf.queryExecution().optimizedPlan().toString()
        below = [plan[m.start() :].split("\n") for m in re.finditer(r"Window \[", plan)]
        assert below
        for lines in below:
            assert "question" not in lines[0] and "line" not in lines[0]
        plans.append(re.sub(r"#\d+L?|\d+", "", plan.split("LocalRelation")[0]))
    assert plans[0] == plans[1]


def test_examples_are_drawn_evenly(spark):
    """Each of 10 training rows is drawn for about 3 in 10 test rows."""
    train, test = topic_table(spark, {"t": 10}), topic_table(spark, {"t": 3_000}, start=100)
    counts = sample_examples(train, test, cap=3).groupBy("train_id").count().collect()
    assert len(counts) == 10 and all(780 < r["count"] < 1_020 for r in counts)
    pairs = collections.Counter()
    drawn = collections.defaultdict(set)
    for r in sample_examples(train, test, cap=2).collect():
        drawn[r["test_id"]].add(r["train_id"])
    for ids in drawn.values():
        pairs[tuple(sorted(ids))] += 1
    # All 45 pairs, about 67 times each.
    assert len(pairs) == 45 and all(30 < n < 110 for n in pairs.values())


def test_few_shot_prompts(spark):
    train = topic_table(spark, {"few": 2})
    test = topic_table(spark, {"few": 1, "unseen": 1}, start=10)
    rows = {r["topic"]: r for r in few_shot_prompts(train, test).collect()}
    assert rows["few"]["context_examples_count"] == 2
    assert rows["few"]["full_prompt"] == (
        "Question: q0\nAnswer: A\n\nQuestion: q1\nAnswer: A\n\nQuestion: q0\nAnswer:"
    )
    assert rows["unseen"]["context_examples_count"] == 0
    assert rows["unseen"]["full_prompt"] == "\n\nQuestion: q1\nAnswer:"


def shuffled_bytes(plan):
    """Bytes that the exchanges of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_bytes(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_bytes(plan.plan())
    own, children = plan.metrics().get("shuffleBytesWritten"), plan.children()
    return (own.get().value() if own.isDefined() else 0) + sum(shuffled_bytes(children.apply(i)) for i in range(children.length()))


def test_few_shot_prompts_shuffle_a_line_once_a_part(spark):
    """Not once for each test row that wants it: 30 lines of 20 KB for 60 rows are 36 MB."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(310)), lambda x: F.sha2(F.concat_ws("-", "id", x), 256)))
    rows = spark.range(90).select(F.col("id").alias("row_id"), F.lit("t").alias("topic"), F.array(F.struct(text.alias("content"))).alias("prompt"), F.lit("A").alias("answers"))
    prompts = few_shot_prompts(rows.where("row_id < 30"), rows.where("row_id >= 30"))
    found = prompts.select("row_id", F.length("full_prompt").alias("n"), F.md5("full_prompt").alias("digest"))
    lines = {r["row_id"]: r["prompt"][0]["content"] for r in rows.collect()}
    context = "\n\n".join(f"Question: {lines[i]}\nAnswer: A" for i in range(30))
    for r in found.collect():
        expected = f"{context}\n\nQuestion: {lines[r['row_id']]}\nAnswer:"
        assert (r["n"], r["digest"]) == (len(expected), hashlib.md5(expected.encode()).hexdigest())
    assert shuffled_bytes(found._jdf.queryExecution().executedPlan()) < 6_000_000


def test_few_shot_prompts_of_repeated_and_missing_ids(spark, monkeypatch):
    from rewardloom.operators import few_shot

    # Several parts for few rows.
    monkeypatch.setattr(few_shot, "LEAST_PER_PART", 2)
    schema = "row_id long, topic string, prompt array<struct<content string>>, answers string, note map<string, int>"
    row = lambda i, t, text, answer="A": (i, t, [(text,)], answer, {text: 1})
    train = spark.createDataFrame([row(1, "t", "b"), row(1, "t", "a"), row(2, "t", "c", None), row(None, "t", "d"), row(3, "u", "e"), row(1, None, "f")], schema)
    test = spark.createDataFrame([row(9, "t", "x"), row(9, "u", "y"), row(None, "t", "z"), row(8, "none", "w")], schema)
    # Rows of one id are all examples wherever it was drawn, here twice for the topic t, and of test rows of one id alike.
    lines = [f"Question: {x}\nAnswer: A" for x in "aabbff"]
    both = "\n\n".join([*lines, "Question: c\nAnswer: None", "Question: e\nAnswer: A"])
    expected = {"x": (both, 8), "y": (both, 8), "z": ("", 0), "w": ("", 0)}
    found = few_shot_prompts(train, test).collect()
    assert len(found) == 4
    for r in found:
        text = r["prompt"][0]["content"]
        context, count = expected[text]
        assert (r["full_prompt"], r["context_examples_count"], r["note"]) == (f"{context}\n\nQuestion: {text}\nAnswer:", count, {text: 1})


def test_few_shot_needs_topics(spark):
    train = topic_table(spark, {"few": 2})
    with pytest.raises(ValueError, match="topic"):
        few_shot_prompts(train.drop("topic"), train)
    for blank in (F.lit(""), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="need a topic"):
            few_shot_prompts(train, train.withColumn("topic", blank)).collect()


# -------------------------------------------------------------- evaluation


def rollouts(spark, responses, truth="A"):
    rows = [(i // 2, i % 2, r, truth, 0.0, 0.0, None if i == 1 else 0.0) for i, r in enumerate(responses)]
    df = spark.createDataFrame(
        rows, "sample_id long, repeat_id int, response string, ground_truth string, logit_a double, logit_b double, logit_c double"
    ).withColumn("question", F.lit("q"))
    return add_prompts(df, DatasetOptions(answer_column="ground_truth"))


def test_evaluation(spark):
    responses = ["<answer>a</answer>", "<answer>B</answer>", "A", " ", "x" * 201, None,
                 "<confidence>80</confidence><answer>A</answer><answer>B</answer>", "</answer>A<answer>"]
    evaluated = evaluate_responses(rollouts(spark, responses))
    rows = evaluated.orderBy("sample_id", "repeat_id").collect()
    assert [r["parsed_successfully"] for r in rows] == [True, True, True, False, False, None, True, True]
    assert [r["is_correct"] for r in rows] == [True, False, True, False, False, False, True, False]
    assert [r["is_error"] for r in rows] == [False] * 5 + [True] + [False] * 2
    assert [r["confidence_score"] for r in rows] == [None] * 6 + [0.8, None]
    assert [r["answer_prob_A"] for r in rows] == [pytest.approx(1 / 3), 0.333, None, None, None, None, pytest.approx(1 / 3), pytest.approx(1 / 3)]
    summary = summarize(evaluated).first().asDict()
    assert summary["test_samples_processed"] == 7 and summary["test_samples_total"] == 4
    assert summary["total_responses"] == 8 and summary["unparseable_answers"] == 3
    assert summary["accuracy"] == 3 / 8 and summary["parsing_success_rate"] == 5 / 8
    assert summary["avg_confidence"] == 0.8 and summary["confidence_availability_rate"] == 1 / 7
    assert summary["probability_extraction_success_rate"] == 4 / 7
    # Over results only, the denominator is 7.
    metrics = result_metrics(result_rows(evaluated)).first().asDict()
    assert metrics == {"accuracy": 3 / 7, "parsing_success_rate": 5 / 7, "correct_answers": 3, "total_answers": 7, "unparseable_answers": 2}


def test_missing_ground_truth(spark):
    evaluated = evaluate_responses(rollouts(spark, ["<answer>A</answer>", " "], truth=None))
    assert [r["is_error"] for r in evaluated.orderBy("repeat_id").collect()] == [True, False]
    assert summarize(evaluated).first()["unparseable_answers"] == 2


def test_summary_of_nothing(spark):
    nothing = evaluate_responses(rollouts(spark, ["A"]).limit(0))
    summary = summarize(nothing).first().asDict()
    assert summary.pop("avg_confidence") is None
    for name in "ABC":
        assert summary.pop(f"avg_answer_prob_{name}") == 0.333
    assert set(summary.values()) == {0}


def test_summary_counts_samples_without_rollouts(spark):
    evaluated = evaluate_responses(rollouts(spark, ["A", "A"]).withColumn("g", F.lit("x")), carry=["g"])
    samples = spark.createDataFrame([("x",), ("x",), ("y",)], "g string")
    rows = {r["g"]: r for r in summarize(evaluated, ["g"], samples).collect()}
    assert rows["x"]["test_samples_total"] == 2 and rows["y"]["test_samples_total"] == 1
    assert rows["y"]["total_responses"] == 0


def test_few_shot_evaluation(spark):
    df = rollouts(spark, [" a because", "A.", "", None]).withColumns({"full_prompt": F.lit("p"), "context_examples_count": F.lit(1)})
    evaluated = evaluate_few_shot(df)
    rows = evaluated.orderBy("sample_id", "repeat_id").collect()
    assert [r["predicted_answer"] for r in rows] == ["a", "A.", "", None]
    assert [r["parsed_successfully"] for r in rows[:3]] == [True, False, False]
    assert [r["answer_prob_A"] for r in rows[:2]] == [pytest.approx(1 / 3), 0.333]
    metrics = few_shot_metrics(evaluated, 2).first().asDict()
    assert metrics == {"accuracy": 0.25, "parsing_success_rate": 0.25, "correct_answers": 1, "total_answers": 4,
                       "unparseable_answers": 3, "num_repeats": 2}


def test_sample_table(spark):
    df = spark.range(150).select(
        F.col("id").alias("sample_id"), F.lit(0).alias("repeat_id"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("question"),
        *[F.lit("A").alias(c) for c in ("predicted_answer", "ground_truth")],
        *[F.lit(True).alias(c) for c in ("is_correct", "parsed_successfully")],
        *[F.lit(0.1).alias(f"answer_prob_{o}") for o in "ABC"],
    )
    rows = sample_table(df.repartition(5)).collect()
    assert [r["sample_id"] for r in rows] == list(range(100)) and len(rows[0]) == 10
    longest = sample_table(df, None).where("sample_id = 101").first()["question"]
    assert longest == "é" * 100 + "..." and sample_table(df, None).count() == 150
    assert sample_table(df, None).where("sample_id = 100").first()["question"] == "é" * 100


def test_rollout_tables(spark):
    samples = spark.range(3).withColumnRenamed("id", "sample_id")
    assert expand_repeats(samples).count() == 24
    assert expand_repeats(samples, 1).count() == 3 and expand_repeats(samples, 0).count() == 0
    repeats = expand_repeats(samples, 2)
    outputs = repeats.where("sample_id > 0").withColumn("logit_a", F.lit(1.0))
    joined = attach_model_outputs(repeats, outputs, ["logit_a"])
    assert joined.count() == 6 and joined.where("logit_a is null").count() == 2


def test_option_probabilities(spark):
    df = spark.createDataFrame([(1000.0, 1000.0, 0.0)], "a double, b double, c double")
    p = option_probabilities({o: F.col(o) for o in "abc"})
    assert tuple(df.select(*p.values()).first()) == (0.5, 0.5, 0.0)


def test_own_scorer(spark):
    from rewardloom.operators.hooks import score_texts

    def make_detector():
        return lambda texts: ["fr" if "é" in text else "en" for text in texts]

    df = spark.createDataFrame([("né",), (None,), ("x",)], "completion string")
    found = df.select(score_texts(make_detector, F.col("completion"), "string").alias("v")).collect()
    assert [r["v"] for r in found] == ["fr", None, "en"]


def test_group_advantage(spark):
    rows = [(1, 1.0), (1, 3.0), (2, 5.0), (2, 5.0), (3, 7.0)]
    df = spark.createDataFrame(rows, "sample_id long, reward_total double")
    found = group_advantage(df, epsilon=0.0001).orderBy("sample_id", "reward_total").collect()
    scaled = 1 / (2**0.5 + 0.0001)
    assert [r["advantage"] for r in found] == pytest.approx([-scaled, scaled, 0, 0, 0])


def test_reward_report(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, None)], "a double, b double")
    rows = {r["reward"]: r.asDict() for r in reward_report(df, ["a", "b"]).collect()}
    assert rows["a"] == {"reward": "a", "scored": 2, "mean": 2.0, "stddev": 2**0.5, "min": 1.0, "max": 3.0, "share_nonzero": 1.0}
    assert rows["b"]["scored"] == 1 and rows["b"]["share_nonzero"] == 0.0


# ----------------------------------------------------------------- options


def test_options():
    config = {"reasoning": {
        "random_seed": 7,
        "model": {"name": "ignored"},
        "dataset": {"path": "p", "train_split": "a", "question_column": "question_text", "two_stage_reasoning": {"think1_column": "t"},
                    "multistep_reasoning_columns": {"step1": "s1"}, "subset_fraction": 0.5},
        "trainer": {"reward_funcs": [{"name": "length", "args": {"optimal_length": 4}}]},
        "baseline": {"num_repeats": 2},
    }}
    options = Options.from_mapping(config)
    assert options == Options.from_mapping(config["reasoning"])
    assert options.random_seed == 7 and options.baseline.num_repeats == 2 and options.evaluation.num_repeats == 8
    assert options.dataset.two_stage_reasoning == TwoStageColumns(think1_column="t")
    assert options.reward_funcs[0]["name"] == "length"
    changed = options.with_splits(test="z")
    assert (changed.dataset.train_split, changed.dataset.test_split) == ("a", "z")
    merged = merge(config["reasoning"], {"dataset": {"train_split": "b"}, "random_seed": 1})
    assert Options.from_mapping(merged).dataset.train_split == "b"
    assert Options.from_mapping(merged).dataset.path == "p"
    assert config["reasoning"]["dataset"]["train_split"] == "a"
