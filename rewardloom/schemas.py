"""Names and types of the tables these jobs exchange."""

from __future__ import annotations

# The answer options and the columns of an evaluation result, in
# the order of the results file.
OPTIONS = ("A", "B", "C")

RESULT_SCHEMA = (
    "sample_id bigint, repeat_id int, question string, predicted_answer string, "
    "ground_truth string, full_response string, parsed_successfully boolean, "
    "is_correct boolean, confidence_score double, answer_prob_A double, "
    "answer_prob_B double, answer_prob_C double"
)
# A few-shot result: no confidence, but the prompt with its examples.
FEW_SHOT_SCHEMA = (
    "sample_id bigint, repeat_id int, question string, predicted_answer string, "
    "ground_truth string, full_response string, full_prompt string, context_examples_count int, "
    "parsed_successfully boolean, is_correct boolean, answer_prob_A double, "
    "answer_prob_B double, answer_prob_C double"
)
RESULT_COLUMNS = [column.split()[0] for column in RESULT_SCHEMA.split(", ")]
