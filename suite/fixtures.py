"""Question and response tables derived from the given tables.

The derivations are SQL expressions that Spark and DuckDB both accept, so that
queries and their check SQL start from the same rows. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.operators.prompts import add_prompts
from rewardloom.operators.rollouts import expand_repeats
from rewardloom.options import DatasetOptions

# Partitions to deal documents into, where the caller wants more tasks than the scan has splits (as bench.py does).
PARTITIONS: int | None = None

SYSTEM_PROMPT = "Answer as the voter would."
REPEATS = 8

# Documents as questions. Labelled documents are the test split.
QUESTIONS = """
SELECT d.doc_id AS row_id,
       CASE WHEN l.doc_id IS NULL THEN 'train' ELSE 'test' END AS split,
       d.text AS question, d.source AS topic, d.lang AS lang,
       substr('ABC', CAST(d.doc_id % 3 AS INT) + 1, 1) AS answer,
       CASE WHEN d.doc_id % 11 = 0 THEN '' WHEN d.doc_id % 13 = 0 THEN NULL
            ELSE 'I agree: ' || d.text END AS answer_comment,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE 'I disagree: ' || d.text END AS dpo_comment,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 4 = 1 THEN ''
            ELSE 'Thinking: ' || d.text END AS reasoning,
       CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'First ' || d.source END AS think1,
       CAST(d.doc_id % 6 AS INT) AS confidence,
       CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE 'Then ' || d.text END AS think2,
       CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'alpha ' || d.source END AS step1,
       CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'beta ' || d.lang END AS step2,
       CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE 'gamma ' || d.text END AS step3
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

GUESS = "substr('ABC', CAST((doc_id + repeat_id) % 3 AS INT) + 1, 1)"
ONE_LINE = "replace(text, chr(10), ' ')"
ANSWER = f"'<answer>' || {GUESS} || '</answer>'"


def _two_stage(confidence: str, answer: str) -> str:
    return (
        f"'<think>' || text || '</think>' || chr(10) || '<confidence>' || {confidence} || "
        f"'</confidence><think>' || source || ' so it is.</think> <answer>' || {answer} || '</answer>'"
    )


# One response per shape: well formed, reversed, repeated, malformed, untagged,
# empty and failed.
SHAPES = [
    f"'<reasoning>' || {ONE_LINE} || '</reasoning>' || chr(10) || {ANSWER}",
    "'<reasoning>' || text || chr(10) || 'Based on the user''s profile.</reasoning> ' || chr(10) "
    f"|| ' <answer> ' || {GUESS} || '</answer> '",
    f"'<reasoning>' || text || '</reasoning><answer> ' || {GUESS} || ') Yes </answer>'",
    f"'<reasoning>' || {ONE_LINE} || '</reasoning><answer>rather no</answer>'",
    _two_stage("CAST((doc_id * 7 + repeat_id * 13) % 101 AS VARCHAR(3))", f"lower({GUESS})"),
    _two_stage("'70'", "'C'"),
    _two_stage("'30'", "'C'"),
    _two_stage("'150'", GUESS),
    _two_stage("' 1.5% '", GUESS),
    f"'<think>' || text || '</think>' || {ANSWER}",
    f"'<confidence> 57 </confidence><answer>A</answer>' || {ONE_LINE} || {ANSWER}",
    f"'</answer>' || {GUESS} || '<answer>' || text",
    f"'The answer is ' || {GUESS}",
    "text",
    "''",
    "'<step1>' || text || '</step1> <step2>' || lang || ' is the second step</step2>' || "
    "CASE WHEN doc_id % 3 = 0 THEN '<step3>short</step3>' WHEN doc_id % 3 = 1 THEN '' "
    f"ELSE chr(10) || '<step3>' || text || '</step3>' END || {ANSWER}",
    "'<thought>' || text || '</thought> so <thought>' || lang || '</thought> then <thought>' || "
    f"source || '</thought>' || chr(10) || {ANSWER}",
    "NULL",
]

# Replies of a model that was shown examples and no tags.
REPLIES = [
    GUESS,
    f"{GUESS} || ' because ' || text",
    f"' ' || lower({GUESS}) || chr(10)",
    f"{GUESS} || '.'",
    "'Answer'",
    "''",
    "NULL",
    "text",
    f"chr(9) || {GUESS} || chr(9) || 'x'",
]


def _choose(number: str, choices: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {choice}" for i, choice in enumerate(choices))
    return f"CASE ({number}) % {len(choices)} {cases} END"


NUMBER = "doc_id * 8 + repeat_id"

ROLLOUT_COLUMNS = {
    "sample_id": "doc_id",
    "repeat_id": "repeat_id",
    "topic": "source",
    "lang": "lang",
    "question": "text",
    "ground_truth": "CASE WHEN doc_id % 29 = 0 THEN NULL "
    "ELSE substr('ABC', CAST(doc_id % 3 AS INT) + 1, 1) END",
    "answer_only": f"({NUMBER}) % 5 = 0",
    "response": _choose(NUMBER, SHAPES),
    "reply": _choose(NUMBER, REPLIES),
    "logit_a": f"CASE WHEN ({NUMBER}) % 19 = 3 THEN NULL "
    "ELSE CAST(doc_id % 7 - 3 AS DOUBLE) / 2 END",
    "logit_b": "CAST((doc_id + repeat_id) % 5 - 2 AS DOUBLE)",
    "logit_c": "CAST(repeat_id % 4 AS DOUBLE) / 4",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.repartition(PARTITIONS, "doc_id") if PARTITIONS else rows


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        QUESTIONS,
        documents=documents(spark, sf_dir),
        labels=table(spark, sf_dir, "labels"),
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeated = expand_repeats(documents(spark, sf_dir), REPEATS)
    columns = [F.expr(sql).alias(name) for name, sql in ROLLOUT_COLUMNS.items()]
    dataset = DatasetOptions(system_prompt=SYSTEM_PROMPT, answer_column="ground_truth")
    prompted = add_prompts(repeated.select(*columns).withColumn("flag", F.col("answer_only")), dataset)
    return prompted.withColumn("answer_only", F.col("flag")).drop("flag", "answers")


def with_class_scores(rollouts: DataFrame) -> DataFrame:
    """Adds a classifier's output; some rows lack a label, some have no output."""

    def entry(label: str, score):
        return F.struct(F.lit(label).alias("label"), score.cast("double").alias("score"))

    number = F.col("sample_id") * 8 + F.col("repeat_id")
    score = (number % 100) / 100.0
    both = F.array(entry("LABEL_0", 1.0 - score), entry("LABEL_1", score))
    return rollouts.withColumn(
        "class_scores",
        F.when(number % 4 == 0, F.array(entry("LABEL_0", score))).when(number % 4 != 1, both),
    )


QUESTIONS_SQL = QUESTIONS.format(documents="documents", labels="labels")
ROLLOUTS_SQL = (
    "SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in ROLLOUT_COLUMNS.items())
    + f" FROM documents CROSS JOIN (SELECT CAST(range AS INT) AS repeat_id FROM range({REPEATS})) r"
)
