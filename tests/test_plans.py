"""Shapes of physical plans: what is shuffled, pushed down and run in Python."""

import re

import pytest
from pyspark.sql import functions as F

from rewardloom.operators.evaluate import evaluate_responses, summarize
from rewardloom.operators.few_shot import sample_examples
from rewardloom.operators.prepare import RowCounts, keep_first
from rewardloom.operators.prompts import add_prompts
from rewardloom.operators.responses import ChatTemplate, preference_pairs, training_texts
from rewardloom.operators.sampling import exact_fraction
from rewardloom.operators.scoring import score
from rewardloom.options import DatasetOptions, TwoStageColumns
from rewardloom.scratch import materialize
from suite import fixtures, rewards


def written_rollouts(spark, sf_dir):
    return materialize(fixtures.with_class_scores(fixtures.rollouts(spark, sf_dir)), "rollouts")


def test_scoring_is_row_wise(spark, sf_dir, plan):
    scores = score(written_rollouts(spark, sf_dir), rewards.SPECS, keep=["sample_id"], **rewards.COLUMNS)
    text = plan(scores)
    assert "Exchange" not in text
    assert not re.search("PythonUDF|EvalPython|MapInPandas|MapInArrow", text)


def test_scoring_parses_once(spark, sf_dir, plan):
    """Rewards share parsed columns instead of each parsing the text again."""
    specs = ["brier_calibration", "focal_confidence", "high_confidence_accuracy"]
    text = plan(score(written_rollouts(spark, sf_dir), specs, keep=["sample_id"], **rewards.COLUMNS))
    top, below = text.split("\n+- ", 1)
    assert "substring_index" not in top and "substring_index" in below


def test_scoring_reads_needed_columns_only(spark, sf_dir, plan):
    scores = score(written_rollouts(spark, sf_dir), ["soft_format"], keep=["sample_id"], **rewards.COLUMNS)
    assert "ReadSchema: struct<sample_id:bigint,response:string>" in plan(scores)


def test_training_tables_are_row_wise(spark, sf_dir, plan):
    df = materialize(fixtures.questions(spark, sf_dir), "questions")
    dataset = DatasetOptions(sft_column="answer_comment", two_stage_reasoning=TwoStageColumns())
    for table in (
        training_texts(df, dataset, ChatTemplate()),
        preference_pairs(df, dataset),
        add_prompts(df, dataset),
    ):
        assert not re.search("Exchange|Python", plan(table))


@pytest.mark.parametrize("observed", [False, True])
def test_dedup_limits_before_the_shuffle(spark, sf_dir, plan, observed):
    documents = fixtures.table(spark, sf_dir, "documents")
    counts = RowCounts() if observed else None
    first = keep_first(documents, "text", "doc_id", counts)
    text = plan(first)
    if observed:
        first.write.format("noop").mode("overwrite").save()
        assert counts.get == {"rows_before": documents.count(), "rows_after": documents.select("text").distinct().count()}
    assert text.count("Exchange") == 1
    partial, final = text.index("row_number(), 1, Partial"), text.index("row_number(), 1, Final")
    assert final < text.index("Exchange") < partial


def test_sample_is_a_filter(spark, sf_dir, plan):
    documents = fixtures.table(spark, sf_dir, "documents")
    text = plan(exact_fraction(documents, 0.37, 1, "doc_id"))
    assert not re.search("Exchange|Sort|Join|Window", text)


def test_few_shot_never_joins_rows_by_topic_alone(spark, sf_dir, plan):
    """Only the two counts per topic are joined by topic."""
    df = materialize(fixtures.questions(spark, sf_dir), "questions")
    text = plan(sample_examples(df.where("split = 'train'"), df.where("split = 'test'"), topic="lang"))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    joins = re.findall(r"(?:SortMergeJoin|HashJoin) \[([^\]]*)\], \[", text)
    by_topic_only = [keys for keys in joins if "," not in keys]
    # The written sizes of the topics, for either table and for the starts of the groups.
    assert len(by_topic_only) == 3 and len(joins) == 5
    for line in text.splitlines():
        if "Window [" in line:
            assert "grp" in line


def test_drawn_positions_are_not_broadcast(spark, sf_dir, plan):
    """Spark takes them for as many as the test rows; eighty times these would pass through the driver."""
    df = materialize(fixtures.questions(spark, sf_dir), "questions")
    pairs = sample_examples(df.where("split = 'train'"), df.where("split = 'test'"), topic="lang")
    pairs.collect()
    text = plan(pairs)
    assert "isFinalPlan=true" in text and not re.search(r"BroadcastHashJoin \[lang#\d+, position#", text)


def test_summary_reads_the_sample_ids_on_their_own(spark, sf_dir, plan):
    evaluated = evaluate_responses(written_rollouts(spark, sf_dir))
    text = plan(summarize(evaluated))
    assert "ReadSchema: struct<sample_id:bigint>" in text


def test_advantage_holds_no_group_in_one_task(spark, sf_dir, plan):
    from rewardloom.operators.advantage import group_advantage

    scores = score(written_rollouts(spark, sf_dir), ["soft_format"], keep=["sample_id"], **rewards.COLUMNS)
    text = plan(group_advantage(materialize(scores, "scores"), reward="soft_format"))
    # The statistics are a written table, one row per group.
    assert "_mean" in text and not re.search("Window|collect_list|Aggregate", text)


def test_report_aggregates_before_it_unpivots(spark, sf_dir, plan):
    from rewardloom.operators.advantage import reward_report

    names = ["soft_format", "multistep_format"]
    scores = score(written_rollouts(spark, sf_dir), names, keep=[], **rewards.COLUMNS)
    text = plan(reward_report(scores, names))
    assert text.index("Generate inline") < text.index("HashAggregate") and text.count("Exchange") == 1


def test_filters_are_pushed_down(spark, sf_dir, plan):
    from rewardloom.operators.prepare import keep_filled

    df = materialize(fixtures.questions(spark, sf_dir), "questions")
    text = plan(keep_filled(df, "answer_comment").select("row_id"))
    assert "IsNotNull(answer_comment), Not(EqualTo(answer_comment,))" in text


def test_evaluation_carries_nothing_it_does_not_need(spark, sf_dir, plan):
    evaluated = evaluate_responses(written_rollouts(spark, sf_dir))
    text = plan(evaluated.agg(F.count_if("parsed_successfully")))
    assert "ReadSchema: struct<response:string>" in text
