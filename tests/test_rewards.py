"""Rewards on hand-made responses, with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from rewardloom.operators.scoring import check_formats, reward_columns, score, total_reward
from rewardloom.rewards import REWARDS

SCHEMA = "id int, completion string, answers string, answer_only boolean"

R = "<reasoning>Because I said so.</reasoning>"
THINK = "<think>0123456789</think>"


def two_stage(confidence, answer, gap=""):
    return f"{THINK}{gap}<confidence>{confidence}</confidence>{THINK}{gap}<answer>{answer}</answer>"


# reward, args, completion, true answer, answer only, expected
CASES = [
    ("right_answer_in_completion", {}, "<answer>A) Yes</answer>", "A", False, 1.0),
    ("right_answer_in_completion", {}, "<answer>rather yes</answer>", "A", False, -0.5),
    ("right_answer_in_completion", {}, "<answer>no</answer>", "B", False, -0.5),
    ("right_answer_in_completion", {}, "<answer>well, A</answer>", "A", False, 0.0),
    ("right_answer_in_completion", {}, "I do, a", "A", False, 0.0),
    ("right_answer_in_completion", {}, "say a", "A", False, 1.0),
    ("right_answer_in_completion", {}, "<ANSWER>b</ANSWER>", "B", False, 1.0),
    ("right_answer_in_completion", {}, "<answer>B</answer><answer>A</answer>", "A", False, 1.0),
    ("answer_in_completion", {"options": ["A", "B"]}, "<answer> rather a </answer>", "X", False, 0.5),
    ("answer_in_completion", {"options": ["A", "B"]}, "<answer>C</answer>", "C", False, 0.0),
    ("answer_in_completion", {"options": ["A", "B"]}, "a", "A", False, 0.0),
    ("answer_distance", {"options": ["A", "B", "C"], "values": [0, 1, 0.25]}, "<answer>C</answer>", "A", False, 1.5),
    ("answer_distance", {"options": ["A", "B", "C"], "values": [0, 1, 0.25]}, "<answer>agree</answer>", "B", False, 0.0),
    ("answer_distance", {"options": ["A", "B", "C"], "values": [0, 1, 0.25]}, "<answer>xyz</answer>", "Z", False, 0.0),
    ("answer_distance", {"options": ["A", "B", "C"], "values": [0, 1, 0.25]}, "<answer>A</answer>", "Z", False, None),
    # No text before or after the tags earns 0.001 each.
    ("xml_format", {}, f"{R}<answer>A</answer>", "A", False, 0.502),
    ("xml_format", {}, f"{R}\n\n<answer>A</answer>", "A", False, 0.5),
    ("xml_format", {}, f"ab{R}<answer>A</answer>c", "A", False, 0.499),
    ("xml_format", {}, "abcde", "A", False, -0.008),
    ("xml_format", {}, "<answer>A</answer>", "A", True, 1.002),
    ("xml_format", {}, "<answer>A</answer><answer>", "A", True, 0.5 + 0.001 - 0.007),
    ("xml_format", {"tokens": ["<t>", "</t>", "<answer>", "</answer>"]}, "<t>x</t>..<answer>A</answer>", "A", False, 0.5),
    ("xml_format", {"tokens": ["aa"]}, "aaa", "A", False, 0.125 + 0.001 - 0.0),
    ("soft_format", {}, f"{R} <answer>A</answer> tail", "A", False, 0.5),
    ("soft_format", {}, f" {R}<answer>A</answer>", "A", False, 0.0),
    ("soft_format", {}, "<reasoning>a\nb</reasoning><answer>A</answer>", "A", False, 0.0),
    ("soft_format", {}, "<reasoning>a\rb</reasoning><answer>A</answer>", "A", False, 0.5),
    ("soft_format", {}, "<reasoning>x</reasoning><answer>y</reasoning>\n<answer>z</answer>", "A", False, 0.5),
    ("soft_format", {"reasoning_tag": "a.b"}, "<a.b>x</a.b><answer>y</answer>", "A", False, 0.5),
    ("soft_format", {"reasoning_tag": "a.b"}, "<aXb>x</aXb><answer>y</answer>", "A", False, 0.0),
    ("hard_format", {"min_group_lengths": [5, 1], "max_group_lengths": [-1, 3]}, f"x{R}\n<answer>A</answer>", "A", False, 1.0),
    ("hard_format", {"min_group_lengths": [5, 1], "max_group_lengths": [-1, 3]}, f"{R}<answer>A) Yes</answer>", "A", False, 0.5),
    ("hard_format", {"min_group_lengths": [5, 1], "max_group_lengths": [-1, 3]}, f"{R}.<answer>A</answer>", "A", False, 0.0),
    ("hard_format", {"min_group_lengths": [], "max_group_lengths": []}, f"{R}<answer></answer>", "A", False, 1.0),
    ("multistep_format", {}, "<thought>a</thought> <thought>b</thought>\n<answer>A</answer>", "A", False, 1.0),
    ("multistep_format", {}, "<thought>a</thought> so <answer>A</answer>", "A", False, 0.0),
    # Two openings 0.2, two closings 2.0, both answer tags 1.0; the first
    # opening costs 1 less its loose text (0), the second 1 less 3 characters.
    ("multistep_xml_format", {"num_thoughts": 2}, "<thought>a</thought> x <thought>b</thought><answer>A</answer>", "A", False, 3.2 - 2 + 0.003),
    ("multistep_xml_format", {"num_thoughts": 1}, "<thought>a</thought><thought>b</thought>", "A", False, 0.3 + 0.3 - 2),
    ("multistep_xml_format", {"num_thoughts": 1}, "", "A", False, 0.0),
    ("modular_step_format", {"step_names": ["p", "q"], "min_step_lengths": [1, 1]}, "<p>a</p>\n<q>b</q><answer>A</answer>", "A", False, 1.0),
    ("modular_step_format", {"step_names": ["p", "q"], "min_step_lengths": [1, 1]}, "<p>a</p>\n<q> </q><answer>A</answer>", "A", False, 0.3),
    ("modular_step_format", {"step_names": ["p", "q"], "min_step_lengths": [1, 1]}, "<q>b</q><p>a</p><answer>A</answer>", "A", False, 0.0),
    ("modular_step_format", {"step_names": ["p"], "min_step_lengths": [1], "max_step_lengths": [2]}, "<p>abc</p><answer>A</answer>", "A", False, 0.3),
    ("three_step_format", {}, "<step1>0123456789</step1><step2>0123456789</step2><step3>0123456789</step3><answer>A</answer>", "A", False, 1.0),
    ("three_step_format", {}, "<step1>0123456789</step1><step2>0123456789</step2><step3>012</step3><answer>A</answer>", "A", False, 0.3),
    ("two_stage_format", {}, two_stage(" 57 ", "A", "\n"), "A", False, 1.0),
    ("two_stage_format", {}, two_stage("101", "A"), "A", False, 0.3),
    ("two_stage_format", {}, two_stage("", "A"), "A", False, 0.3),
    ("two_stage_format", {"min_think_lengths": [11]}, two_stage("50", "A"), "A", False, 0.3),
    ("two_stage_format", {}, f"{THINK}<answer>A</answer>", "A", False, 0.0),
    ("length", {"optimal_length": 10}, "äöü", "A", False, -0.007),
    ("length", {"optimal_length": 10}, "äöü", "A", True, 0.0),
    ("profile_used_reward", {"profile_dims": ["Age"]}, "<reasoning>age matters</reasoning>", "A", False, 1.0),
    ("profile_used_reward", {"profile_dims": ["Age"]}, "<reasoning>The User's past and age</reasoning>", "A", False, 1.5),
    ("profile_used_reward", {"profile_dims": []}, "<reasoning>x</reasoning> the user's past", "A", False, 0.0),
    ("language", {"language": "de"}, "Das ist nicht der Fall und das ist gut.", "A", False, 1.0),
    ("language", {"language": "en"}, "", "A", False, 1.0),
    ("confidence_aware_answer", {}, "A", "A", False, 0.0),
    ("confidence_aware_answer", {}, "<answer>A</answer>", "A", False, 0.9),
    ("confidence_aware_answer", {}, "<answer>A</answer>", "B", False, 0.1),
    ("confidence_aware_answer", {}, two_stage("70", "C"), "A", False, -0.3),
    ("confidence_aware_answer", {}, two_stage("70", "C"), "C", False, 1.0),
    ("confidence_aware_answer", {}, two_stage("70", "B"), "A", False, -0.5),
    ("confidence_aware_answer", {}, two_stage("69", "A"), "a ", False, 0.5),
    ("confidence_aware_answer", {}, two_stage("49", "C"), "A", False, 0.4),
    ("confidence_aware_answer", {}, two_stage("50", "C"), "A", False, 0.2),
    # 57 comes back from 0..1 as 56.99999999999999.
    ("confidence_aware_answer", {"confidence_threshold": 57}, two_stage("57", "A"), "A", False, 0.5),
    ("brier_calibration", {}, two_stage("80", "A"), "A", False, 0.5 - 0.5 * 0.04),
    ("brier_calibration", {}, two_stage("80", "A"), "B", False, -0.32),
    ("brier_calibration", {"sharpness_weight": 1.0}, two_stage("80", "A"), "B", False, -0.02),
    ("brier_calibration", {}, two_stage("30", "C"), "C", False, 0.5),
    ("brier_calibration", {}, two_stage("x", "C"), "C", False, -1.0),
    ("brier_calibration", {}, "<answer>A</answer>", "A", False, 0.0),
    ("loglikelihood_calibration", {}, two_stage("100", "A"), "B", False, 0.5 * math.log(1 - (1 - 1e-8))),
    ("loglikelihood_calibration", {}, two_stage("0", "C"), "C", False, 0.5),
    ("focal_confidence", {}, two_stage("80", "A"), "B", False, -0.4 * 0.64),
    ("focal_confidence", {}, two_stage("30", "c"), "C", False, 0.0),
    ("high_confidence_accuracy", {}, two_stage("70", "C"), "A", False, 0.0),
    ("high_confidence_accuracy", {}, two_stage("70", "B"), "A", False, -0.5),
    ("high_confidence_accuracy", {}, two_stage("70", "C"), "C", False, 1.0),
    ("high_confidence_accuracy", {}, two_stage("69", "B"), "A", False, 0.0),
    ("low_confidence_humility", {}, two_stage("49", "C"), "A", False, 0.0),
    ("low_confidence_humility", {}, two_stage("50", "C"), "A", False, 0.2),
    ("low_confidence_humility", {}, two_stage("49", "C"), "C", False, 0.5),
    ("neutral_when_uncertain", {}, two_stage("49", "C"), "A", False, 0.4),
    ("neutral_when_uncertain", {}, two_stage("49", "C"), "C", False, 0.0),
    ("high_confidence_neutral_penalty", {}, two_stage("70", "C"), "A", False, -0.3),
    ("high_confidence_neutral_penalty", {"neutral_answer": " b"}, two_stage("70", "B"), "A", False, -0.3),
    ("confidence_provision", {}, "<answer>A</answer>", "A", False, -0.05),
    ("confidence_provision", {}, two_stage("1000", "A"), "B", False, -0.1),
    ("confidence_provision", {}, "A", "B", False, 0.0),
    ("neutral_ground_truth", {}, two_stage("49", "C"), "C", False, 0.5),
    ("neutral_ground_truth", {}, two_stage("50", "C"), "C", False, 0.0),
    ("simple_confidence", {}, two_stage("40", "B) No"), "B", False, 0.4),
    ("simple_confidence", {}, two_stage("40", "Because"), "A", False, -0.4),
    ("simple_confidence", {}, two_stage("40", "C"), "C", False, 0.0),
    ("simple_confidence", {"allow_neutral": False}, two_stage("40", "C"), "C", False, -0.4),
    ("simple_confidence", {}, "<answer>A</answer>", "A", False, -0.1),
]


def test_cases(spark):
    """All cases in one job: each row is scored by every case's reward."""
    rows = [(i, c[2], c[3], c[4]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, SCHEMA)
    wrong = []
    for start in range(0, len(CASES), 25):
        part = CASES[start : start + 25]
        specs = [{"name": name, "args": args} for name, args, *_ in part]
        columns = reward_columns(specs)
        found = score(df, specs, keep=["id"]).where(F.col("id").between(start, start + 24)).collect()
        for row in found:
            name, args, completion, truth, _, expected = CASES[row["id"]]
            value = row[columns[row["id"] - start]]
            if value != (pytest.approx(expected, abs=1e-9) if expected is not None else None):
                wrong.append((name, args, completion, truth, value, expected))
    assert wrong == []


def test_cases_cover_all_rewards():
    assert {case[0] for case in CASES} | {"entailment"} == set(REWARDS)


def test_null_inputs_give_null(spark):
    df = spark.createDataFrame([(1, None, "A", False), (2, "<answer>A</answer>", None, False)], SCHEMA)
    specs = ["right_answer_in_completion", "soft_format", "brier_calibration", "xml_format"]
    rows = {r["id"]: r.asDict() for r in score(df, specs, keep=["id"]).collect()}
    assert [rows[1][s] for s in specs] == [None] * 4
    assert rows[2]["right_answer_in_completion"] is None and rows[2]["brier_calibration"] is None
    assert rows[2]["soft_format"] == 0.0 and rows[2]["xml_format"] is not None


def test_entailment(spark):
    schema = "id int, completion string, answers string, class_scores array<struct<label:string,score:double>>"
    both = [("LABEL_0", 0.3), ("LABEL_1", 0.7)]
    df = spark.createDataFrame(
        [(1, "x", "A", both), (2, "x", "C", both), (3, "x", "a", both), (4, "x", "A", both[:1]),
         (5, "x", "A", []), (6, "x", "A", None)],
        schema,
    )
    rows = {r["id"]: r["entailment"] for r in score(df, ["entailment"], keep=["id"]).collect()}
    assert rows == {1: 1.4, 2: 0.6, 3: 0.6, 4: 0.6, 5: None, 6: None}


def test_language_from_a_detector_column(spark):
    df = spark.createDataFrame([("x", "fr"), ("x", None)], "completion string, found string")
    spec = {"name": "language", "args": {"language": "fr", "detected_column": "found"}}
    assert [r["language"] for r in score(df, [spec]).collect()] == [1.0, 0.0]


@pytest.mark.parametrize(
    "specs",
    [
        ["three_step_format", "xml_format"],
        ["modular_step_format", "multistep_format"],
        ["three_step_format", "modular_step_format"],
        ["two_stage_format", "soft_format"],
        ["two_stage_format", "three_step_format"],
        ["two_stage_format", "multistep_xml_format"],
    ],
)
def test_conflicting_formats(specs):
    with pytest.raises(ValueError):
        check_formats([{"name": name} for name in specs])


@pytest.mark.parametrize(
    "specs", [["hard_format", "xml_format", "multistep_format"], ["two_stage_format", "length"], []]
)
def test_compatible_formats(specs):
    check_formats(specs)


def test_unknown_reward_and_missing_columns(spark):
    df = spark.createDataFrame([("x",)], "completion string")
    with pytest.raises(ValueError, match="unknown reward"):
        score(df, ["nope"])
    with pytest.raises(ValueError, match="answers"):
        score(df, ["brier_calibration"])
    with pytest.raises(ValueError, match="class_scores"):
        score(df.withColumn("answers", F.lit("A")), ["entailment"])


def test_total_and_repeated_rewards(spark):
    df = spark.createDataFrame([("abc",)], "completion string")
    specs = [{"name": "length", "args": {"optimal_length": n}} for n in (3, 5)]
    assert reward_columns(specs) == ["length", "length_2"]
    scored = score(df, specs).select(total_reward(["length", "length_2"], [1.0, 10.0]).alias("t"))
    assert scored.first()["t"] == pytest.approx(-0.02)


def test_scores_do_not_depend_on_partitioning(spark, sf_dir):
    from suite import fixtures, rewards

    rollouts = fixtures.with_class_scores(fixtures.rollouts(spark, sf_dir))

    def run(n):
        scores = score(rollouts.repartition(n), rewards.SPECS, keep=["sample_id", "repeat_id"], **rewards.COLUMNS)
        return sorted(map(tuple, scores.collect()), key=lambda r: r[:2])

    assert run(1) == run(16)
