"""A query and check SQL for every operator but the rewards.

Long texts are compared by digest and length, so that results stay narrow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rewardloom.functions import parse
from rewardloom.functions.language import detect_language
from rewardloom.functions.text import after_last, before_first, first_word, has_pair, occurrences
from rewardloom.operators.evaluate import (
    evaluate_few_shot,
    evaluate_responses,
    few_shot_metrics,
    result_metrics,
    result_rows,
    sample_table,
    summarize,
)
from rewardloom.operators.few_shot import few_shot_prompts, sample_examples
from rewardloom.operators.hooks import score_texts
from rewardloom.operators.option_tokens import probabilities_of_likeliest, spellings, vocabulary_of
from rewardloom.operators.prepare import RowCounts, keep_filled, keep_first, without_topic
from rewardloom.operators.prompts import add_prompts, example_line, few_shot_prompt, last_content
from rewardloom.operators.responses import ChatTemplate, equal_pairs, preference_pairs, tagged_response
from rewardloom.operators.rollouts import (
    attach_ground_truth,
    attach_model_outputs,
    expand_repeats,
    option_probabilities,
)
from rewardloom.operators.sampling import exact_fraction, in_sample_order
from rewardloom.operators.scoring import check_formats, score
from rewardloom.operators.advantage import group_advantage, reward_report
from rewardloom.options import DatasetOptions, Options, TwoStageColumns, merge
from rewardloom.plans.evaluation import evaluate_and_store
from rewardloom.plans.preparation import prepare, prepare_from
from rewardloom.plans.scoring import advantages, score_rollouts
from rewardloom.plans.training import build_training_tables, dpo_table, sft_table
from rewardloom.scratch import materialize, scratch_path
from rewardloom.schemas import FEW_SHOT_SCHEMA
from rewardloom.operators.evaluation_state import coarser, read_state, state_of, summary_of, write_state
from rewardloom.sources import arrow_shards
from rewardloom.sources.copartitioned import load, store, with_ground_truth, with_group_advantage, with_model_outputs
from rewardloom.sources.results import read_csv, read_json, write_csv, write_json, write_metrics
from rewardloom.sources.splits import load_sft_table, load_split, load_splits, write_splits
from rewardloom.streaming.groups import write_advantages
from rewardloom.streaming.online import write_scores
from suite import fixtures, rewards, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEED = 42
FRACTION = 0.3
CAP = 80
PLAIN = DatasetOptions(
    system_prompt=fixtures.SYSTEM_PROMPT, sft_column="answer_comment", subset_fraction=FRACTION
)
STAGED = DatasetOptions(
    system_prompt=fixtures.SYSTEM_PROMPT,
    sft_column="answer_comment",
    two_stage_reasoning=TwoStageColumns(),
)
STEPPED = DatasetOptions(
    system_prompt=fixtures.SYSTEM_PROMPT,
    sft_column="answer_comment",
    multistep_reasoning_columns={"step1": "step1", "step2": "step2", "step3": "step3"},
)
TEMPLATE = ChatTemplate(
    start="<|begin|>", before="<|start|>", between="<|end|>\n\n", after="<|eot|>"
)
# The format rewards that may be used together with the other rewards.
TRAINING_SPECS = [
    spec for spec in rewards.SPECS
    if spec["name"] not in ("three_step_format", "modular_step_format", "two_stage_format", "entailment")
]
SHIPPED_SPECS = [
    {"name": "right_answer_in_completion"},
    {"name": "xml_format", "args": {"tokens": ["<reasoning>", "</reasoning>", "<answer>", "</answer>"]}},
    {"name": "hard_format", "args": {"min_group_lengths": [200, 1], "max_group_lengths": [5000, 3]}},
    {"name": "length", "args": {"optimal_length": 400}},
]
WEIGHTS = [1.0, 0.5, 2.0, 1.0]


def check(name: str, oracle: str | None = None):
    def add(query):
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


def digest(text: Column, name: str) -> list[Column]:
    return [F.md5(text).alias(f"{name}_md5"), F.length(text).cast("long").alias(f"{name}_length")]


def digest_sql(text: str, name: str) -> str:
    return f"md5({text}) AS {name}_md5, length({text}) AS {name}_length"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places; counts stay as they are."""
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# ---------------------------------------------------------------- sources


QUESTION_COLUMNS = "row_id, split, topic, lang, answer"


@check(
    "scan_test_split",
    sql.questions(
        f"SELECT {QUESTION_COLUMNS}, {digest_sql('question', 'question')} FROM q WHERE split = 'test'"
    ),
)
def scan_test_split(spark, sf_dir):
    path = scratch_path(spark, "questions")
    write_splits(fixtures.questions(spark, sf_dir), path)
    _, test = load_splits(spark, DatasetOptions(path=path))
    return test.select(*QUESTION_COLUMNS.split(", "), *digest(F.col("question"), "question"))


@check(
    "scan_separate_training_table",
    sql.questions(
        f"SELECT {QUESTION_COLUMNS}, {digest_sql('answer_comment', 'comment')} FROM q WHERE split = 'train'"
    ),
)
def scan_separate_training_table(spark, sf_dir):
    path = scratch_path(spark, "questions")
    write_splits(fixtures.questions(spark, sf_dir), path)
    dataset = DatasetOptions(sft_column="answer_comment", sft_dataset_path=path)
    table = load_sft_table(spark, dataset)
    return table.select(*QUESTION_COLUMNS.split(", "), *digest(F.col("answer_comment"), "comment"))


@check(
    "scan_table_without_splits",
    sql.questions(f"SELECT row_id, topic, lang, {digest_sql('question', 'question')} FROM q"),
)
def scan_table_without_splits(spark, sf_dir):
    path = scratch_path(spark, "questions")
    fixtures.questions(spark, sf_dir).drop("split").write.parquet(path)
    table = load_split(spark, path)
    return table.select("row_id", "topic", "lang", *digest(F.col("question"), "question"))


def write_arrow_shards(df: DataFrame, path: str) -> None:
    """Write a table as Arrow shards, one per task, with the list of them."""
    import json

    from pyarrow import fs

    def write(batches):
        import uuid

        import pyarrow as pa

        filesystem, folder = fs.FileSystem.from_uri(path)
        name, stream, file = f"data-{uuid.uuid4().hex}.arrow", None, None
        for batch in batches:
            if stream is None:
                file = filesystem.open_output_stream(f"{folder}/{name}")
                stream = pa.ipc.new_stream(file, batch.schema)
            stream.write_batch(batch)
        if stream is not None:
            stream.close()
            file.close()
            yield pa.RecordBatch.from_pydict({"filename": [name]})

    filesystem, folder = fs.FileSystem.from_uri(path)
    filesystem.create_dir(folder, recursive=True)
    # Only shards of tasks that succeeded are listed.
    files = [row["filename"] for row in df.mapInArrow(write, "filename string").collect()]
    with filesystem.open_output_stream(f"{folder}/state.json") as file:
        file.write(json.dumps({"_data_files": [{"filename": f} for f in sorted(files)]}).encode())


@check(
    "scan_arrow_shards",
    f"SELECT doc_id, lang, source, n_chars, {digest_sql('text', 'text')} FROM documents",
)
def scan_arrow_shards(spark, sf_dir):
    path = scratch_path(spark, "arrow")
    write_arrow_shards(fixtures.table(spark, sf_dir, "documents"), path)
    arrow_shards.register(spark)
    table = spark.read.format("arrow_shards").load(path)
    return table.select("doc_id", "lang", "source", "n_chars", *digest(F.col("text"), "text"))


@check(
    "scan_arrow_batches",
    "SELECT doc_id, n_chars, md5(text) AS text_md5, count(*) OVER () AS n_rows, 0::BIGINT AS first_row, count(*) OVER () - 1 AS last_row FROM documents",
)
def scan_arrow_batches(spark, sf_dir):
    """A shard read in many runs of its record batches by a written index, with row numbers without gaps."""
    path = scratch_path(spark, "arrow")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "64")
    # Two shards at least, else as many as the table has splits.
    documents = fixtures.table(spark, sf_dir, "documents")
    write_arrow_shards(documents.repartition(max(2, documents.rdd.getNumPartitions()), "doc_id"), path)
    spark.conf.set(size, before)
    arrow_shards.register(spark)
    index = scratch_path(spark, "index")
    arrow_shards.write_index(spark, path, index)
    reader = spark.read.format("arrow_shards").option("row_id", "row_id").option("partition_bytes", str(256 << 10)).option("index", index)
    rows = materialize(reader.option("columns", "doc_id, text, n_chars").load(path), "batches")
    ends = rows.agg(F.countDistinct("row_id").alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
    # One row.
    return rows.select("doc_id", "n_chars", F.md5("text").alias("text_md5")).crossJoin(F.broadcast(ends))


@check(
    "scan_arrow_shards_mixed",
    "SELECT doc_id, n_chars, md5(text) AS text_md5, true AS is_numbered FROM documents WHERE lang = 'en'",
)
def scan_arrow_shards_mixed(spark, sf_dir):
    """Named columns of shards that order theirs differently, with a filter and row numbers."""
    import json

    path = scratch_path(spark, "arrow")
    documents = fixtures.table(spark, sf_dir, "documents")
    halves = [documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1").select("lang", "text", "n_chars", "doc_id")]
    for i, half in enumerate(halves):
        write_arrow_shards(half, f"{path}/train/{i}")
    from pyarrow import fs

    filesystem, folder = fs.FileSystem.from_uri(path)

    def read(name):
        with filesystem.open_input_file(f"{folder}/{name}") as file:
            return json.loads(file.read())

    def write(name, content):
        with filesystem.open_output_stream(f"{folder}/{name}") as file:
            file.write(json.dumps(content).encode())

    files = [f"{i}/{f['filename']}" for i in (0, 1) for f in read(f"train/{i}/state.json")["_data_files"]]
    write("train/state.json", {"_data_files": [{"filename": f} for f in files]})
    write("dataset_dict.json", {"splits": ["train"]})
    arrow_shards.register(spark)
    reader = spark.read.format("arrow_shards").option("split", "train").option("row_id", "row_id")
    rows = reader.option("columns", "doc_id, text, lang, n_chars").load(path).where("lang = 'en'")
    return rows.select("doc_id", "n_chars", F.md5("text").alias("text_md5"), (F.col("row_id") >= 0).alias("is_numbered"))


# ---------------------------------------------------------------- prompts


SYSTEM_SQL = f"'{fixtures.SYSTEM_PROMPT}'"


def _messages(prompt: str) -> list[Column]:
    last = F.try_element_at(prompt, F.lit(-1))
    return [
        F.size(prompt).cast("long").alias("messages"),
        F.array_join(F.col(prompt)["role"], ",").alias("roles"),
        *digest(F.array_join(F.col(prompt)["content"], "|"), "contents"),
        last["role"].alias("last_role"),
        *digest(last_content(F.col(prompt)), "last_content"),
    ]


@check(
    "question_prompts",
    sql.questions(
        "SELECT row_id, answer AS answers, false AS answer_only, 2::BIGINT AS messages, "
        f"'system,user' AS roles, {digest_sql(f'{SYSTEM_SQL} || chr(124) || question', 'contents')}, "
        f"'user' AS last_role, {digest_sql('question', 'last_content')} FROM q"
    ),
)
def question_prompts(spark, sf_dir):
    prompted = add_prompts(fixtures.questions(spark, sf_dir), PLAIN)
    return prompted.select("row_id", "answers", "answer_only", *_messages("prompt"))


_PREFILLED = f"{SYSTEM_SQL} || '|' || question || coalesce('|' || reasoning, '')"


@check(
    "reasoning_prompts",
    sql.questions(
        "SELECT row_id, answer AS answers, reasoning IS NOT NULL AS answer_only, "
        "CASE WHEN reasoning IS NULL THEN 2 ELSE 3 END::BIGINT AS messages, "
        "CASE WHEN reasoning IS NULL THEN 'system,user' ELSE 'system,user,assistant' END AS roles, "
        f"{digest_sql(_PREFILLED, 'contents')}, "
        "CASE WHEN reasoning IS NULL THEN 'user' ELSE 'assistant' END AS last_role, "
        f"{digest_sql('coalesce(reasoning, question)', 'last_content')} FROM q"
    ),
)
def reasoning_prompts(spark, sf_dir):
    dataset = DatasetOptions(system_prompt=fixtures.SYSTEM_PROMPT, reasoning_column="reasoning")
    prompted = add_prompts(fixtures.questions(spark, sf_dir), dataset)
    return prompted.select("row_id", "answers", "answer_only", *_messages("prompt"))


# -------------------------------------------------------------- responses


def _single(comment: str) -> str:
    return f"('<reasoning>' || coalesce({comment}, 'None') || '</reasoning><answer>' || answer || '</answer>')"


_STAGED_SQL = (
    "CASE WHEN think1 <> '' AND confidence <> 0 AND think2 <> '' THEN "
    "'<think>' || think1 || '</think><confidence>' || confidence || '</confidence><think>' || "
    f"think2 || '</think><answer>' || answer || '</answer>' ELSE {_single('answer_comment')} END"
)
_STEPS_SQL = "concat(" + ", ".join(
    f"CASE WHEN {s} <> '' THEN '<{s}>' || {s} || '</{s}>' END" for s in ("step1", "step2", "step3")
) + ")"


def _stepped(comment: str) -> str:
    return (
        f"CASE WHEN {_STEPS_SQL} <> '' THEN {_STEPS_SQL} || '<answer>' || answer || '</answer>' "
        f"ELSE {_single(comment)} END"
    )


def _response_query(dataset):
    def query(spark, sf_dir):
        df = fixtures.questions(spark, sf_dir)
        return df.select("row_id", *digest(tagged_response(df, dataset), "response"))

    return query


for _name, _dataset, _text in (
    ("response_single", PLAIN, _single("answer_comment")),
    ("response_two_stage", STAGED, _STAGED_SQL),
    ("response_multistep", STEPPED, _stepped("answer_comment")),
):
    check(_name, sql.questions(f"SELECT row_id, {digest_sql(_text, 'response')} FROM q"))(
        _response_query(_dataset)
    )


# What Python writes for a question that is missing on some rows.
NULL_QUESTION = "CASE WHEN row_id % 4 <> 1 THEN question ELSE 'None' END"


def _chat_sql(response: str, question: str = "question") -> str:
    def message(role, content):
        return f"'<|start|>{role}<|end|>' || chr(10) || chr(10) || {content} || '<|eot|>'"

    return "'<|begin|>' || " + " || ".join(
        [message("system", SYSTEM_SQL), message("user", question), message("assistant", response)]
    )


FILLED = "answer_comment <> ''"
BOTH_FILLED = "answer_comment <> '' AND dpo_comment <> ''"


@check(
    "training_texts",
    sql.questions(
        f"SELECT row_id, {digest_sql(_chat_sql(f'({_STAGED_SQL})'), 'text')} FROM q WHERE {FILLED}"
    ),
)
def training_texts(spark, sf_dir):
    train = fixtures.questions(spark, sf_dir)
    tables = build_training_tables(
        train, train, Options(dataset=STAGED), "sft", TEMPLATE, keep=["row_id"]
    )
    return tables["texts"].select("row_id", *digest(F.col("text"), "text"))


@check(
    "training_texts_of_separate_table",
    sql.questions(
        f"SELECT row_id, {digest_sql(_chat_sql(_single('answer_comment')), 'text')} FROM q "
        "WHERE split = 'train'"
    ),
)
def training_texts_of_separate_table(spark, sf_dir):
    path = scratch_path(spark, "questions")
    write_splits(fixtures.questions(spark, sf_dir), path)
    dataset = DatasetOptions(
        path=path,
        sft_dataset_path=path,
        sft_column="answer_comment",
        system_prompt=fixtures.SYSTEM_PROMPT,
    )
    train, test = load_splits(spark, dataset)
    separate = load_sft_table(spark, dataset)
    tables = build_training_tables(
        train, test, Options(dataset=dataset), "sft", TEMPLATE, separate, ["row_id"]
    )
    return tables["texts"].select("row_id", *digest(F.col("text"), "text"))


@check(
    "training_texts_of_null_questions",
    sql.questions(
        f"SELECT row_id, {digest_sql(_chat_sql(_single('answer_comment'), question=NULL_QUESTION), 'text')} FROM q WHERE {FILLED}"
    ),
)
def training_texts_of_null_questions(spark, sf_dir):
    """A NULL question is written None; the user's message stays."""
    train = fixtures.questions(spark, sf_dir).withColumn("question", F.expr("CASE WHEN row_id % 4 <> 1 THEN question END"))
    texts = build_training_tables(train, train, Options(dataset=PLAIN), "sft", TEMPLATE, keep=["row_id"])["texts"]
    return texts.select("row_id", *digest(F.col("text"), "text"))


NUMBERS = "CASE row_id % 8 WHEN 0 THEN 0.0005 WHEN 1 THEN 12345678.9 WHEN 2 THEN 1e16 WHEN 3 THEN 0.00001 WHEN 4 THEN -2.5e-7 WHEN 5 THEN 57.0 WHEN 6 THEN 1e7 ELSE -123456789012.25 END"
# The same numbers as Python writes them.
WRITTEN = "CASE row_id % 8 WHEN 0 THEN '0.0005' WHEN 1 THEN '12345678.9' WHEN 2 THEN '1e+16' WHEN 3 THEN '1e-05' WHEN 4 THEN '-2.5e-07' WHEN 5 THEN '57.0' WHEN 6 THEN '10000000.0' ELSE '-123456789012.25' END"


@check(
    "response_number_text",
    sql.questions(
        f"SELECT row_id, '<think>' || row_id || '</think><confidence>' || {WRITTEN} || '</confidence><think>x</think><answer>' || answer || '</answer>' AS response FROM q"
    ),
)
def response_number_text(spark, sf_dir):
    """Doubles and a bigint training column in a two-stage response."""
    table = fixtures.questions(spark, sf_dir).withColumns(
        {"confidence": F.expr(f"CAST({NUMBERS} AS DOUBLE)"), "think1": F.col("row_id").cast("string"), "think2": F.lit("x"), "answer_comment": F.col("row_id")}
    )
    kept = keep_filled(table, "answer_comment")
    return kept.select("row_id", tagged_response(kept, STAGED).alias("response"))


@check(
    "preference_pairs",
    sql.questions(
        f"SELECT row_id, {digest_sql('question', 'question')}, "
        f"{digest_sql(_stepped('answer_comment'), 'chosen')}, "
        f"{digest_sql(_stepped('dpo_comment'), 'rejected')} FROM q WHERE {BOTH_FILLED}"
    ),
)
def preference_pairs_query(spark, sf_dir):
    train = fixtures.questions(spark, sf_dir)
    pairs = build_training_tables(train, train, Options(dataset=STEPPED), keep=["row_id"])["pairs"]
    return pairs.select(
        "row_id",
        *digest(last_content(F.col("prompt")), "question"),
        *digest(F.col("chosen"), "chosen"),
        *digest(F.col("rejected"), "rejected"),
    )


@check(
    "preference_pairs_equal",
    sql.questions(
        "SELECT topic, count(*) AS pairs, "
        f"count(*) FILTER (WHERE {_stepped('answer_comment')} = {_stepped('dpo_comment')}) AS equal_pairs "
        f"FROM q WHERE {BOTH_FILLED} GROUP BY topic"
    ),
)
def preference_pairs_equal(spark, sf_dir):
    train = keep_filled(fixtures.questions(spark, sf_dir), "answer_comment", "dpo_comment")
    pairs = preference_pairs(train, STEPPED, ["topic"])
    return pairs.groupBy("topic").agg(
        F.count(F.lit(1)).alias("pairs"), equal_pairs().alias("equal_pairs")
    )


@check(
    "sft_dpo_tables",
    sql.questions(
        f"SELECT 'texts' AS kind, row_id, {digest_sql(_chat_sql(_single('answer_comment')), 'text')} "
        f"FROM q WHERE split = 'train' AND {FILLED} UNION ALL "
        f"SELECT 'pairs', row_id, {digest_sql(_single('dpo_comment'), 'text')} "
        f"FROM q WHERE split = 'train' AND {BOTH_FILLED}"
    ),
)
def sft_dpo_tables(spark, sf_dir):
    train, test = _splits(spark, sf_dir)
    tables = build_training_tables(
        train, test, Options(dataset=PLAIN), "sft_dpo", TEMPLATE, keep=["row_id"]
    )
    texts = tables["texts"].select(F.lit("texts").alias("kind"), "row_id", "text")
    pairs = tables["pairs"].select(F.lit("pairs").alias("kind"), "row_id", F.col("rejected").alias("text"))
    return texts.unionByName(pairs).select("kind", "row_id", *digest(F.col("text"), "text"))


# ---------------------------------------------- filters, dedup, sampling


def _splits(spark, sf_dir):
    table = fixtures.questions(spark, sf_dir)
    return table.where("split = 'train'"), table.where("split = 'test'")


@check("filled_rows", sql.questions(f"SELECT row_id, topic FROM q WHERE {FILLED}"))
def filled_rows(spark, sf_dir):
    return keep_filled(fixtures.questions(spark, sf_dir), "answer_comment").select("row_id", "topic")


@check("filled_row_pairs", sql.questions(f"SELECT row_id, topic FROM q WHERE {BOTH_FILLED}"))
def filled_row_pairs(spark, sf_dir):
    table = fixtures.questions(spark, sf_dir)
    return keep_filled(table, "answer_comment", "dpo_comment").select("row_id", "topic")


@check(
    "keep_first_questions",
    "SELECT doc_id AS row_id, lang, source AS topic, "
    f"{digest_sql('text', 'question')} FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def keep_first_questions(spark, sf_dir):
    documents = fixtures.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "lang", F.col("source").alias("topic"), F.col("text").alias("question")
    )
    kept = keep_first(documents, "question")
    return kept.select("row_id", "lang", "topic", *digest(F.col("question"), "question"))


def _fraction_sql(rows: str, fraction: float) -> str:
    """Cut a row source down to its seeded fraction."""
    return (
        f"SELECT * FROM {rows} QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || row_id), row_id) "
        f"<= CAST(floor(count(*) OVER () * {fraction}::DOUBLE) AS BIGINT)"
    )


@check(
    "exact_fraction",
    sql.questions(
        f"SELECT row_id, topic, {digest_sql('question', 'question')} FROM ({_fraction_sql('q', FRACTION)})"
    ),
)
def exact_fraction_query(spark, sf_dir):
    sample = exact_fraction(fixtures.questions(spark, sf_dir), FRACTION, SEED)
    return sample.select("row_id", "topic", *digest(F.col("question"), "question"))


_DEDUPED = (
    "d AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY split, question ORDER BY row_id) = 1)"
)


@check(
    "prepared_splits",
    sql.questions(
        f"SELECT split, row_id, answer AS answers, {digest_sql('question', 'question')} FROM "
        "(SELECT * FROM s UNION ALL SELECT * FROM d WHERE split = 'test')",
        _DEDUPED,
        "t AS (SELECT * FROM d WHERE split = 'train')",
        f"s AS ({_fraction_sql('t', FRACTION)})",
    ),
)
def prepared_splits(spark, sf_dir):
    train, test = prepare(*_splits(spark, sf_dir), Options(dataset=PLAIN, random_seed=SEED))
    both = train.unionByName(test)
    return both.select("split", "row_id", "answers", *digest(last_content(F.col("prompt")), "question"))


@check(
    "prepared_splits_with_duplicates",
    sql.questions(
        f"SELECT split, row_id, answer AS answers, {digest_sql('question', 'question')} FROM "
        "(SELECT * FROM s UNION ALL SELECT * FROM q WHERE split = 'test')",
        "t AS (SELECT * FROM q WHERE split = 'train')",
        f"s AS ({_fraction_sql('t', FRACTION)})",
    ),
)
def prepared_splits_with_duplicates(spark, sf_dir):
    options = Options(dataset=PLAIN, random_seed=SEED)
    train, test = prepare(*_splits(spark, sf_dir), options, dedup=False)
    both = train.unionByName(test)
    return both.select("split", "row_id", "answers", *digest(last_content(F.col("prompt")), "question"))


# --------------------------------------------------------------- few-shot


def _few_shot_ctes(topic: str) -> list[str]:
    """Number each topic's training rows, draw positions, look the rows up."""
    draw = (
        "CAST('0x' || substr(md5(" + f"'{SEED}:' || test_id || ':' || x[1]" + "), 1, 15) AS BIGINT) "
        f"% (n - {CAP} + x[1] + 1)"
    )
    return [
        f"n AS (SELECT {topic} AS topic, row_id, question, answer, count(*) OVER (PARTITION BY {topic}) AS n, "
        f"row_number() OVER (PARTITION BY {topic} ORDER BY md5(row_id::VARCHAR), row_id) - 1 AS position "
        "FROM q WHERE split = 'train')",
        f"t AS (SELECT q.row_id AS test_id, q.{topic} AS topic, n FROM q JOIN "
        "(SELECT DISTINCT topic, n FROM n) s ON s.topic = q." + topic + " WHERE split = 'test')",
        f"w AS (SELECT test_id, topic, n, unnest(CASE WHEN n <= {CAP} THEN range(n) ELSE "
        f"list_reduce(list_transform(range({CAP}), lambda i: [i]), lambda acc, x: list_append(acc, "
        f"CASE WHEN list_contains(acc, {draw}) THEN n - {CAP} + x[1] ELSE {draw} END), "
        "[]::BIGINT[]) END) AS position FROM t)",
        "pairs AS (SELECT w.test_id, n.row_id AS train_id, n.question, n.answer, "
        f"CASE WHEN n.n <= {CAP} THEN '' ELSE md5('{SEED}:' || w.test_id || ':' || n.row_id) END AS place "
        "FROM w JOIN n ON n.topic = w.topic AND n.position = w.position)",
    ]


_CONTEXT = (
    "c AS (SELECT test_id, count(*) AS k, string_agg('Question: ' || question || chr(10) || 'Answer: ' || "
    "answer, chr(10) || chr(10) ORDER BY place, train_id) AS context FROM pairs GROUP BY test_id)"
)
_FULL_PROMPT = (
    "coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || q.question || chr(10) || 'Answer:'"
)


def _prompted_splits(spark, sf_dir):
    train, test = _splits(spark, sf_dir)
    return add_prompts(train, PLAIN), add_prompts(test, PLAIN)


def _examples_query(topic):
    def query(spark, sf_dir):
        return sample_examples(*_splits(spark, sf_dir), topic=topic, cap=CAP, seed=SEED)

    return query


def _prompts_query(topic):
    def query(spark, sf_dir):
        train, test = _prompted_splits(spark, sf_dir)
        prompts = few_shot_prompts(train, test, topic=topic, cap=CAP, seed=SEED)
        return prompts.select(
            "row_id",
            F.col("context_examples_count").cast("long").alias("context_examples_count"),
            *digest(F.col("full_prompt"), "full_prompt"),
        )

    return query


for _topic in ("topic", "lang"):
    _suffix = {"topic": "source", "lang": "language"}[_topic]
    check(
        f"few_shot_examples_by_{_suffix}",
        sql.questions("SELECT test_id, train_id, place FROM pairs", *_few_shot_ctes(_topic)),
    )(_examples_query(_topic))
    check(
        f"few_shot_prompts_by_{_suffix}",
        sql.questions(
            "SELECT q.row_id, coalesce(k, 0) AS context_examples_count, "
            f"{digest_sql(_FULL_PROMPT, 'full_prompt')} FROM q LEFT JOIN c ON c.test_id = q.row_id "
            "WHERE q.split = 'test'",
            *_few_shot_ctes(_topic),
            _CONTEXT,
        ),
    )(_prompts_query(_topic))


_LINE = "'Question: ' || question || chr(10) || 'Answer: ' || answer"
_OPEN = "chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:'"


@check(
    "few_shot_lines",
    sql.questions(
        f"SELECT row_id, {digest_sql(_LINE, 'line')}, {digest_sql(_OPEN, 'prompt')} FROM q"
    ),
)
def few_shot_lines(spark, sf_dir):
    df = add_prompts(fixtures.questions(spark, sf_dir), PLAIN)
    none = F.array().cast("array<string>")
    return df.select(
        "row_id",
        *digest(example_line(df), "line"),
        *digest(few_shot_prompt(none, last_content(F.col("prompt"))), "prompt"),
    )


# ---------------------------------------------------------- rollout joins


@check(
    "repeats",
    "SELECT doc_id AS sample_id, CAST(range AS INT) AS repeat_id FROM documents, range(8)",
)
def repeats(spark, sf_dir):
    documents = fixtures.table(spark, sf_dir, "documents")
    return expand_repeats(documents.select(F.col("doc_id").alias("sample_id")))


@check(
    "ground_truth_joined",
    sql.rollouts(
        f"SELECT sample_id, repeat_id, q.answer AS answers, {digest_sql('response', 'response')} "
        "FROM r LEFT JOIN q ON q.row_id = r.sample_id AND q.row_id % 6 <> 2",
        f"q AS ({fixtures.QUESTIONS_SQL})",
    ),
)
def ground_truth_joined(spark, sf_dir):
    samples = fixtures.questions(spark, sf_dir).select(
        F.col("row_id").alias("sample_id"), F.col("answer").alias("answers")
    ).where("sample_id % 6 <> 2")
    joined = attach_ground_truth(fixtures.rollouts(spark, sf_dir), samples, ["answers"])
    return joined.select("sample_id", "repeat_id", "answers", *digest(F.col("response"), "response"))


@check(
    "model_outputs_joined",
    sql.rollouts(
        "SELECT sample_id, repeat_id, CASE WHEN logit_a IS NULL THEN NULL ELSE logit_a END AS logit_a, "
        "CASE WHEN logit_a IS NULL THEN NULL ELSE logit_b END AS logit_b FROM r"
    ),
)
def model_outputs_joined(spark, sf_dir):
    rollouts = fixtures.rollouts(spark, sf_dir)
    outputs = rollouts.where(F.col("logit_a").isNotNull())
    columns = ["logit_a", "logit_b"]
    return attach_model_outputs(rollouts.drop("logit_a", "logit_b"), outputs, columns).select(
        "sample_id", "repeat_id", *columns
    )


def _stored(df, name: str, **layout):
    """A table stored by sample, loaded as another session would."""
    path = scratch_path(df.sparkSession, name)
    store(df, path, **layout)
    return load(df.sparkSession, path)


@check("ground_truth_joined_stored", ORACLES["ground_truth_joined"])
def ground_truth_joined_stored(spark, sf_dir):
    samples = fixtures.questions(spark, sf_dir).select(
        F.col("row_id").alias("sample_id"), F.col("answer").alias("answers")
    ).where("sample_id % 6 <> 2")
    rollouts = _stored(fixtures.rollouts(spark, sf_dir), "rollouts")
    joined = with_ground_truth(rollouts, _stored(samples, "samples", within=None, like=rollouts), ["answers"])
    return joined.select("sample_id", "repeat_id", "answers", *digest(F.col("response"), "response"))


@check("model_outputs_joined_stored", ORACLES["model_outputs_joined"])
def model_outputs_joined_stored(spark, sf_dir):
    rollouts = fixtures.rollouts(spark, sf_dir)
    columns = ["logit_a", "logit_b"]
    outputs = rollouts.where(F.col("logit_a").isNotNull()).select("sample_id", "repeat_id", *columns)
    stored = _stored(rollouts.drop(*columns), "rollouts")
    return with_model_outputs(stored, _stored(outputs, "outputs", like=stored), columns).select("sample_id", "repeat_id", *columns)


# ---------------------------------------------------------------- parsing


@check(
    "parsed_answers",
    sql.rollouts(
        f"SELECT sample_id, repeat_id, {digest_sql('ans', 'last_answer')}, {digest_sql('lettered', 'lettered')}, "
        f"{digest_sql('reas', 'reasoning')}, ha AS has_answer, hc AS has_confidence, ans = truth AS is_same, "
        f"{digest_sql(sql.first_tagged('c', 'answer'), 'first_answer')}, "
        f"md5(regexp_extract({sql.strip('reply')}, '^([^{sql.S[1:-1]}]+)', 1)) AS first_word_md5 FROM p",
        sql.PARSED,
    ),
)
def parsed_answers(spark, sf_dir):
    c, low = F.col("response"), F.lower("response")
    return fixtures.rollouts(spark, sf_dir).select(
        "sample_id",
        "repeat_id",
        *digest(parse.last_tagged(low, "answer"), "last_answer"),
        *digest(parse.lettered_answer(c), "lettered"),
        *digest(parse.last_tagged(low, "reasoning"), "reasoning"),
        has_pair(c, "answer").alias("has_answer"),
        has_pair(c, "confidence").alias("has_confidence"),
        parse.same_answer(parse.last_tagged(low, "answer"), F.col("ground_truth")).alias("is_same"),
        *digest(
            F.when(F.contains(c, F.lit("<answer>")), parse.first_tagged(c, "answer")).otherwise(
                F.when(c.isNotNull(), "")
            ),
            "first_answer",
        ),
        F.md5(first_word(F.col("reply"))).alias("first_word_md5"),
    )


@check(
    "parsed_confidence",
    sql.rollouts(
        "SELECT p.sample_id, p.repeat_id, round(conf, 6) AS strict, conf * 100.0 >= 57 AS reaches_57, "
        "round(CASE WHEN p.hc THEN CASE WHEN number > 1 THEN number / 100 ELSE number END END, 6) AS lenient, "
        "e.parsed_successfully AS is_parsed "
        "FROM p JOIN e ON e.sample_id = p.sample_id AND e.repeat_id = p.repeat_id",
        sql.PARSED,
        sql.EVALUATED,
    ),
)
def parsed_confidence(spark, sf_dir):
    c = F.col("response")
    return fixtures.rollouts(spark, sf_dir).select(
        "sample_id",
        "repeat_id",
        F.round(parse.strict_confidence(c), 6).alias("strict"),
        (parse.strict_confidence(c) * 100.0 >= 57).alias("reaches_57"),
        F.round(parse.lenient_confidence(c), 6).alias("lenient"),
        parse.is_parsed(c).alias("is_parsed"),
    )


_BEFORE = "split_part(response, '<answer>', 1)"
_AFTER = "split_part(response, '</answer>', -1)"
_PROBE = f"CASE WHEN contains(response, '<answer>') THEN {_BEFORE} || '<answer>' END"


@check(
    "tag_positions",
    sql.rollouts(
        "SELECT sample_id, repeat_id, CAST((length(response) - length(replace(response, '<answer>', ''))) / 8 AS BIGINT) "
        "AS tags, CAST(strpos(response, '<answer>') - 1 AS BIGINT) AS first_tag, "
        f"{digest_sql(_BEFORE, 'before')}, {digest_sql(_AFTER, 'after')}, {digest_sql(_PROBE, 'probe')} FROM r"
    ),
)
def tag_positions(spark, sf_dir):
    c = F.col("response")
    return fixtures.rollouts(spark, sf_dir).select(
        "sample_id",
        "repeat_id",
        occurrences(c, "<answer>").cast("long").alias("tags"),
        (F.instr(c, "<answer>") - 1).cast("long").alias("first_tag"),
        *digest(before_first(c, "<answer>"), "before"),
        *digest(after_last(c, "</answer>"), "after"),
        *digest(parse.answer_probe(c), "probe"),
    )


@check(
    "option_probabilities",
    sql.rollouts(
        "SELECT sample_id, repeat_id, round(answer_prob_A, 6) AS prob_a, round(answer_prob_B, 6) AS prob_b, "
        "round(answer_prob_C, 6) AS prob_c FROM e",
        sql.EVALUATED,
    ),
)
def option_probabilities_query(spark, sf_dir):
    logits = {o: F.col(f"logit_{o}") for o in "abc"}
    probabilities = option_probabilities(logits, F.col("response"))
    return fixtures.rollouts(spark, sf_dir).select(
        "sample_id",
        "repeat_id",
        *[F.round(p, 6).alias(f"prob_{o}") for o, p in probabilities.items()],
    )


@check("option_probabilities_of_likeliest", ORACLES["option_probabilities"])
def option_probabilities_of_likeliest(spark, sf_dir):
    """The same from maps of likeliest tokens, with each option's probability spread over its spellings in a tokenizer file."""
    import public_tokenizers

    ids = spellings(vocabulary_of(spark, public_tokenizers.path("byte_bpe_50k.json")))
    entries = [F.struct(F.lit(-1).alias("id"), F.lit(-0.5).alias("logprob"))]
    for option, tokens in ids.items():
        for k, token in enumerate(tokens):
            share = (2 * k + 1) / len(tokens) ** 2
            logit = F.col(f"logit_{option.lower()}")
            entries.append(F.when(logit.isNotNull(), F.struct(F.lit(token).alias("id"), (logit + F.log(F.lit(share))).alias("logprob"))))
    rollouts = fixtures.rollouts(spark, sf_dir).withColumn("likeliest", F.map_from_entries(F.array_compact(F.array(*entries))))
    found = probabilities_of_likeliest(F.col("likeliest"), ids, F.col("response"))
    return rollouts.select("sample_id", "repeat_id", *[F.round(p, 6).alias(f"prob_{o.lower()}") for o, p in found.items()])


@check(
    "entailment_by_own_scorer",
    sql.rollouts(
        "SELECT sample_id, repeat_id, CASE WHEN g IS NULL THEN NULL ELSE round(2.0 * CASE WHEN g IN ('A', 'B') "
        "THEN (length(reas) % 100)::DOUBLE / 100 ELSE 1 - (length(reas) % 100)::DOUBLE / 100 END, 6) END "
        "AS entailment FROM p",
        sql.PARSED,
    ),
)
def entailment_by_own_scorer(spark, sf_dir):
    """A stand-in for a classifier, run on the reasoning of every response."""

    def make_scorer():
        def scorer(texts):
            scores = [len(text) % 100 / 100 for text in texts]
            return [
                [{"label": "LABEL_0", "score": 1 - s}, {"label": "LABEL_1", "score": s}] for s in scores
            ]

        return scorer

    reasoning = parse.last_tagged(F.lower("response"), "reasoning")
    scored = fixtures.rollouts(spark, sf_dir).withColumn(
        "class_scores",
        score_texts(make_scorer, reasoning, "array<struct<label:string,score:double>>"),
    )
    spec = [{"name": "entailment"}]
    return rounded(score(scored, spec, keep=["sample_id", "repeat_id"], **rewards.COLUMNS))


# ------------------------------------------------------------- evaluation


RESULT_SQL = (
    f"sample_id, repeat_id, {digest_sql('question', 'question')}, {digest_sql('predicted_answer', 'predicted')}, "
    f"ground_truth, {digest_sql('response', 'response')}, parsed_successfully, is_correct, "
    "round(confidence_score, 6) AS confidence_score, round(answer_prob_A, 6) AS answer_prob_A, "
    "round(answer_prob_B, 6) AS answer_prob_B, round(answer_prob_C, 6) AS answer_prob_C"
)
RESULTS_ORACLE = sql.rollouts(f"SELECT {RESULT_SQL} FROM e WHERE NOT is_error", sql.EVALUATED)


def _shown(results: DataFrame) -> DataFrame:
    return rounded(
        results.select(
            "sample_id",
            "repeat_id",
            *digest(F.col("question"), "question"),
            *digest(F.col("predicted_answer"), "predicted"),
            "ground_truth",
            *digest(F.col("full_response"), "response"),
            "parsed_successfully",
            "is_correct",
            "confidence_score",
            "answer_prob_A",
            "answer_prob_B",
            "answer_prob_C",
        )
    )


def _results(spark, sf_dir) -> DataFrame:
    return result_rows(evaluate_responses(fixtures.rollouts(spark, sf_dir)))


@check("evaluation_results", RESULTS_ORACLE)
def evaluation_results(spark, sf_dir):
    return _shown(_results(spark, sf_dir))


@check("results_as_json", RESULTS_ORACLE)
def results_as_json(spark, sf_dir):
    path = scratch_path(spark, "results-json")
    write_json(_results(spark, sf_dir), path, compression="gzip")
    return _shown(read_json(spark, path))


@check("results_as_csv", RESULTS_ORACLE)
def results_as_csv(spark, sf_dir):
    path = scratch_path(spark, "results-csv")
    write_csv(_results(spark, sf_dir), path, compression="gzip")
    return _shown(read_csv(spark, path))


@check("results_as_csv_by_ranges", RESULTS_ORACLE)
def results_as_csv_by_ranges(spark, sf_dir):
    """Large files, as many as tasks wrote them, each read by several tasks."""
    path, size = scratch_path(spark, "results-csv"), "spark.sql.files.maxPartitionBytes"
    write_csv(_results(spark, sf_dir), path, compression="zstd", rows_per_file=0)
    before = spark.conf.get(size)
    spark.conf.set(size, "2m")
    found = read_csv(spark, path, by_ranges=True)
    spark.conf.set(size, before)
    return _shown(found)


def _table_sql(limit: str) -> str:
    return sql.rollouts(
        "SELECT sample_id, repeat_id, CASE WHEN length(question) > 100 THEN substr(question, 1, 100) || '...' "
        "ELSE question END AS question, md5(predicted_answer) AS predicted_md5, ground_truth, is_correct, "
        "parsed_successfully, round(answer_prob_A, 6) AS prob_A, round(answer_prob_B, 6) AS prob_B, "
        f"round(answer_prob_C, 6) AS prob_C FROM e WHERE NOT is_error {limit}",
        sql.EVALUATED,
    )


def _table_query(limit):
    def query(spark, sf_dir):
        table = sample_table(_results(spark, sf_dir), limit)
        return rounded(
            table.withColumn("predicted_md5", F.md5("predicted_answer")).drop("predicted_answer")
        )

    return query


check("results_table_first_100", _table_sql("ORDER BY sample_id, repeat_id LIMIT 100"))(_table_query(100))
check("results_table_all", _table_sql(""))(_table_query(None))


def _summary_sql(by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    return sql.rollouts(
        f"SELECT {by + ',' if by else ''} count(*) FILTER (WHERE NOT is_error) AS test_samples_processed, "
        "count(DISTINCT sample_id) AS test_samples_total, count(*) AS total_responses, "
        "count(*) FILTER (WHERE NOT is_error AND is_correct) AS correct_answers, "
        "count(*) FILTER (WHERE is_error OR NOT parsed_successfully) AS unparseable_answers, "
        "round(count(*) FILTER (WHERE NOT is_error AND is_correct) / count(*), 6) AS accuracy, "
        "round(count(*) FILTER (WHERE NOT is_error AND parsed_successfully) / count(*), 6) AS parsing_success_rate, "
        "round(coalesce(avg(answer_prob_A) FILTER (WHERE NOT is_error), 0.333), 6) AS avg_answer_prob_A, "
        "round(coalesce(avg(answer_prob_B) FILTER (WHERE NOT is_error), 0.333), 6) AS avg_answer_prob_B, "
        "round(coalesce(avg(answer_prob_C) FILTER (WHERE NOT is_error), 0.333), 6) AS avg_answer_prob_C, "
        "round(avg(confidence_score) FILTER (WHERE NOT is_error), 6) AS avg_confidence, "
        "round(count(confidence_score) FILTER (WHERE NOT is_error) / count(*) FILTER (WHERE NOT is_error), 6) "
        "AS confidence_availability_rate, "
        "round(count(answer_prob_A) FILTER (WHERE NOT is_error) / count(*) FILTER (WHERE NOT is_error), 6) "
        f"AS probability_extraction_success_rate FROM e {group}",
        sql.EVALUATED,
    )


@check("summary", _summary_sql())
def summary(spark, sf_dir):
    return rounded(summarize(evaluate_responses(fixtures.rollouts(spark, sf_dir))))


@check("summary_by_topic", _summary_sql("topic"))
def summary_by_topic(spark, sf_dir):
    evaluated = evaluate_responses(fixtures.rollouts(spark, sf_dir), carry=["topic"])
    samples = fixtures.table(spark, sf_dir, "documents").select(F.col("source").alias("topic"))
    return rounded(summarize(evaluated, by=["topic"], samples=samples))


def _merged_runs(spark, sf_dir, by):
    """States of three runs that share their samples, kept by run and merged; no run is evaluated twice."""
    path = scratch_path(spark, "states")
    evaluated = evaluate_responses(fixtures.rollouts(spark, sf_dir), carry=["topic"])
    for run in range(3):
        write_state(state_of(evaluated.where(F.col("repeat_id") % 3 == run), ["topic"]), path, f"run-{run}")
    return rounded(summary_of(coarser(read_state(spark, path, ["topic"]), by)))


@check("summary_of_merged_runs", _summary_sql())
def summary_of_merged_runs(spark, sf_dir):
    return _merged_runs(spark, sf_dir, [])


@check("summary_by_topic_of_merged_runs", _summary_sql("topic"))
def summary_by_topic_of_merged_runs(spark, sf_dir):
    return _merged_runs(spark, sf_dir, ["topic"])


@check("stored_evaluation", _summary_sql("lang"))
def stored_evaluation(spark, sf_dir):
    """The written summary, read back."""
    path = scratch_path(spark, "evaluation")
    stored = evaluate_and_store(fixtures.rollouts(spark, sf_dir), path, by=["lang"])
    return rounded(spark.read.schema(stored.schema).json(f"{path}/summary"))


def _metrics_sql(source: str, correct: str, unparseable: str, extra: str = "") -> str:
    return (
        f"SELECT topic, round(count(*) FILTER (WHERE {correct}) / count(*), 6) AS accuracy, "
        f"round((count(*) - count(*) FILTER (WHERE {unparseable})) / count(*), 6) AS parsing_success_rate, "
        f"count(*) FILTER (WHERE {correct}) AS correct_answers, count(*) AS total_answers, "
        f"count(*) FILTER (WHERE {unparseable}) AS unparseable_answers {extra} FROM {source} GROUP BY topic"
    )


@check(
    "result_metrics_by_topic",
    sql.rollouts(
        _metrics_sql(
            "(SELECT * FROM e WHERE NOT is_error)", "is_correct", "NOT parsed_successfully"
        ),
        sql.EVALUATED,
    ),
)
def result_metrics_by_topic(spark, sf_dir):
    evaluated = evaluate_responses(fixtures.rollouts(spark, sf_dir), carry=["topic"])
    return rounded(result_metrics(result_rows(evaluated), by=["topic"]))


FEW_SHOT_PROMPT = "chr(10) || chr(10) || 'Question: ' || r.question"


def _few_shot_evaluated(spark, sf_dir, carry=None):
    rollouts = fixtures.rollouts(spark, sf_dir).withColumns(
        {
            "full_prompt": F.concat(F.lit("\n\nQuestion: "), "question"),
            "context_examples_count": (F.col("sample_id") % 80).cast("int"),
        }
    )
    return evaluate_few_shot(rollouts, response="reply", carry=carry)


@check(
    "few_shot_results",
    sql.rollouts(
        f"SELECT f.sample_id, f.repeat_id, {digest_sql('predicted_answer', 'predicted')}, f.ground_truth, "
        f"{digest_sql('f.text', 'response')}, {digest_sql('r.question', 'question')}, "
        f"{digest_sql(FEW_SHOT_PROMPT, 'full_prompt')}, CAST(f.sample_id % 80 AS INT) AS context_examples_count, "
        "parsed_successfully, is_correct, round(answer_prob_A, 6) AS answer_prob_A, "
        "round(answer_prob_B, 6) AS answer_prob_B, round(answer_prob_C, 6) AS answer_prob_C "
        "FROM f JOIN r ON r.sample_id = f.sample_id AND r.repeat_id = f.repeat_id WHERE NOT is_error",
        sql.REPLIED,
    ),
)
def few_shot_results(spark, sf_dir):
    results = result_rows(_few_shot_evaluated(spark, sf_dir))
    return rounded(
        results.select(
            "sample_id",
            "repeat_id",
            *digest(F.col("predicted_answer"), "predicted"),
            "ground_truth",
            *digest(F.col("full_response"), "response"),
            *digest(F.col("question"), "question"),
            *digest(F.col("full_prompt"), "full_prompt"),
            "context_examples_count",
            "parsed_successfully",
            "is_correct",
            "answer_prob_A",
            "answer_prob_B",
            "answer_prob_C",
        )
    )


@check(
    "few_shot_metrics_by_topic",
    sql.rollouts(
        _metrics_sql(
            "f",
            "NOT is_error AND is_correct",
            "is_error OR NOT parsed_successfully",
            ", 8 AS num_repeats",
        ),
        sql.REPLIED,
    ),
)
def few_shot_metrics_by_topic(spark, sf_dir):
    evaluated = _few_shot_evaluated(spark, sf_dir, carry=["topic"])
    return rounded(few_shot_metrics(evaluated, fixtures.REPEATS, by=["topic"]))


# ------------------------------------------- in-context learning end to end


def _reply_sql(question: str, number: str) -> str:
    """A model's replies, made of the prompt's question and the ids."""
    letter = f"substr('ABC', CAST(({number}) % 3 AS INT) + 1, 1)"
    return (
        f"CASE ({number}) % 5 WHEN 0 THEN {letter} WHEN 1 THEN {letter} || ' because ' || {question} "
        f"WHEN 2 THEN ' ' || lower({letter}) || chr(10) WHEN 3 THEN '' ELSE NULL END"
    )


_ICL_NUMBER = "row_id * 8 + repeat_id"
_ICL = (
    *_few_shot_ctes("topic"),
    _CONTEXT,
    "a AS (SELECT q.row_id, q.question, q.answer, CAST(coalesce(k, 0) AS INT) AS k, "
    f"{_FULL_PROMPT} AS full_prompt FROM q LEFT JOIN c ON c.test_id = q.row_id WHERE q.split = 'test')",
    f"b AS (SELECT a.*, CAST(range AS INT) AS repeat_id, {_reply_sql('question', 'row_id * 8 + range')} AS reply FROM a, range(8))",
    f"e AS (SELECT *, {sql.strip('reply')} AS text, regexp_extract({sql.strip('reply')}, '^([^{sql.S[1:-1]}]+)', 1) AS predicted FROM b)",
)


def _icl_prompts(spark, sf_dir):
    options = Options.from_mapping(
        {
            "reasoning": {
                "dataset": {"system_prompt": fixtures.SYSTEM_PROMPT},
                "baseline": {"num_repeats": fixtures.REPEATS, "max_context_examples": CAP},
                "random_seed": SEED,
            }
        }
    )
    train, test = _splits(spark, sf_dir)
    train, test = prepare(train, test, options, dedup=False)
    return build_training_tables(train, test, options, "in_context_learning")["prompts"]


def _icl_evaluated(spark, sf_dir):
    """Splits, few-shot prompts, repeats, replies, and their evaluation."""
    prompts = _icl_prompts(spark, sf_dir)
    replies = prompts.withColumns(
        {"reply": F.expr(_reply_sql("question", _ICL_NUMBER)), "sample_id": F.col("row_id"), "logit_a": F.lit(None).cast("double"), "logit_b": F.lit(0.0), "logit_c": F.lit(0.0)}
    )
    return evaluate_few_shot(replies, response="reply", ground_truth="answers")


@check(
    "in_context_learning",
    sql.questions(
        f"SELECT row_id AS sample_id, repeat_id, {digest_sql('question', 'question')}, {digest_sql('predicted', 'predicted')}, "
        f"answer AS ground_truth, {digest_sql('text', 'response')}, {digest_sql('full_prompt', 'full_prompt')}, "
        "k AS context_examples_count, upper(predicted) IN ('A', 'B', 'C') AS parsed_successfully, "
        "upper(predicted) = upper(answer) AS is_correct, 0.333::DOUBLE AS answer_prob_A, 0.333::DOUBLE AS answer_prob_B, "
        "0.333::DOUBLE AS answer_prob_C FROM e WHERE text IS NOT NULL",
        *_ICL,
    ),
)
def in_context_learning(spark, sf_dir):
    """The written few-shot results, read back by their own schema."""
    path = scratch_path(spark, "few-shot-results")
    # A row holds a prompt of up to CAP texts, and a sample's repeats hold the same one.
    write_json(result_rows(_icl_evaluated(spark, sf_dir)), path, compression="zstd", rows_per_file=1_000)
    results = read_json(spark, path, FEW_SHOT_SCHEMA)
    return rounded(
        results.select(
            "sample_id",
            "repeat_id",
            *digest(F.col("question"), "question"),
            *digest(F.col("predicted_answer"), "predicted"),
            "ground_truth",
            *digest(F.col("full_response"), "response"),
            *digest(F.col("full_prompt"), "full_prompt"),
            "context_examples_count",
            "parsed_successfully",
            "is_correct",
            *[f"answer_prob_{o}" for o in "ABC"],
        )
    )


@check(
    "in_context_learning_metrics",
    sql.questions(
        "SELECT round(count(*) FILTER (WHERE text IS NOT NULL AND upper(predicted) = upper(answer)) / count(*), 6) AS accuracy, "
        "round(count(*) FILTER (WHERE text IS NOT NULL AND upper(predicted) IN ('A', 'B', 'C')) / count(*), 6) AS parsing_success_rate, "
        "count(*) FILTER (WHERE text IS NOT NULL AND upper(predicted) = upper(answer)) AS correct_answers, count(*) AS total_answers, "
        "count(*) FILTER (WHERE text IS NULL OR upper(predicted) NOT IN ('A', 'B', 'C')) AS unparseable_answers, 8 AS num_repeats FROM e",
        *_ICL,
    ),
)
def in_context_learning_metrics(spark, sf_dir):
    """The written metrics record, read back."""
    path = scratch_path(spark, "few-shot-metrics")
    metrics = few_shot_metrics(_icl_evaluated(spark, sf_dir), fixtures.REPEATS)
    write_metrics(metrics, path)
    return rounded(spark.read.schema(metrics.schema).json(path))


# ------------------------------------------------ checks, counts and options


@check(
    "rows_without_topic",
    sql.questions("SELECT row_id, split FROM q WHERE row_id % 9 IN (0, 1)"),
)
def rows_without_topic(spark, sf_dir):
    """Rows put aside because few-shot prompts need a topic; the others pass."""
    topic = F.expr("CASE row_id % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE topic END")
    return without_topic(fixtures.questions(spark, sf_dir).withColumn("topic", topic)).select("row_id", "split")


_COUNTS = "SELECT '{step}' AS step, count(*) AS rows_before, count(*) FILTER (WHERE {kept}) AS rows_after FROM {rows}"


_FORMATS = ["hard_format", "modular_step_format", "multistep_format", "multistep_xml_format", "soft_format", "three_step_format", "two_stage_format", "xml_format"]


@check(
    "format_pairs",
    f"""WITH n AS (SELECT unnest({_FORMATS}) AS name), f AS (SELECT name, CASE WHEN name IN ('hard_format', 'soft_format', 'xml_format') THEN 'plain'
        WHEN name IN ('three_step_format', 'modular_step_format') THEN 'modular' WHEN name = 'two_stage_format' THEN 'staged' ELSE 'multistep' END AS family FROM n),
    w AS (SELECT a.name AS first_format, b.name AS second_format, NOT (
        (a.family = 'modular') <> (b.family = 'modular') AND (a.family IN ('plain', 'multistep') OR b.family IN ('plain', 'multistep'))
        OR a.family = 'modular' AND b.family = 'modular'
        OR (a.family = 'staged') <> (b.family = 'staged')  AND (a.family IN ('plain', 'multistep', 'modular') OR b.family IN ('plain', 'multistep', 'modular'))) AS accepted
        FROM f a JOIN f b ON a.name < b.name),
    l AS (SELECT lang, list_sort(list(DISTINCT {_FORMATS}[1 + doc_id % 8])) AS used FROM documents GROUP BY lang, doc_id % 5)
    SELECT first_format, second_format, accepted, count(*) FILTER (WHERE list_contains(used, first_format) AND list_contains(used, second_format)) AS configured
    FROM w CROSS JOIN l GROUP BY ALL""",
)
def format_pairs(spark, sf_dir):
    """Which pairs of format rewards may be used together, and how many configurations (here: of documents' groups) have both."""
    from itertools import combinations

    def accepted(pair):
        try:
            check_formats(pair)
        except ValueError:
            return False
        return True

    pairs = [(a, b, accepted([a, b])) for a, b in combinations(_FORMATS, 2)]
    judged = spark.createDataFrame(pairs, "first_format string, second_format string, accepted boolean")
    names = F.array(*map(F.lit, _FORMATS))
    used = fixtures.table(spark, sf_dir, "documents").groupBy("lang", (F.col("doc_id") % 5).alias("part")).agg(
        F.collect_set(F.get(names, (F.col("doc_id") % 8).cast("int"))).alias("used")
    )
    # A pair of eight names for each configuration that has both.
    both = used.select(F.explode("used").alias("first_format"), "used").select("first_format", F.explode("used").alias("second_format"))
    counts = both.groupBy("first_format", "second_format").agg(F.count("*").alias("n"))
    joined = judged.join(counts, ["first_format", "second_format"], "left")
    return joined.select("first_format", "second_format", "accepted", F.coalesce("n", F.lit(0).cast("long")).alias("configured"))


@check(
    "rows_before_and_after",
    sql.questions(
        " UNION ALL ".join(
            [
                _COUNTS.format(step="dedup", kept="first", rows="(SELECT row_number() OVER (PARTITION BY question ORDER BY row_id) = 1 AS first FROM q WHERE split = 'train')"),
                _COUNTS.format(step="texts", kept=FILLED, rows="q"),
                _COUNTS.format(step="pairs", kept=BOTH_FILLED, rows="q"),
            ]
        )
    ),
)
def rows_before_and_after(spark, sf_dir):
    """What deduplication and the filters of both training tables drop."""
    train = fixtures.questions(spark, sf_dir)
    options = Options(dataset=PLAIN)
    tables = {}
    tables["dedup"] = lambda o: keep_first(train.where("split = 'train'"), "question", observation=o)
    tables["texts"] = lambda o: sft_table(train, options, TEMPLATE, observation=o)
    tables["pairs"] = lambda o: dpo_table(train, options, observation=o)
    rows = []
    for step, build in tables.items():
        observation = RowCounts(step) if step == "dedup" else Observation(step)
        build(observation).write.format("noop").mode("overwrite").save()
        rows.append((step, observation.get["rows_before"], observation.get["rows_after"]))
    return spark.createDataFrame(rows, "step string, rows_before long, rows_after long")


@check(
    "sample_in_order",
    sql.questions(
        f"SELECT row_id, row_number() OVER (ORDER BY md5('{SEED}:' || row_id), row_id) - 1 AS position, {digest_sql('question', 'question')} FROM q WHERE split = 'train'"
    ),
)
def sample_in_order(spark, sf_dir):
    """The training rows numbered in the order the sample takes them."""
    rows = materialize(fixtures.questions(spark, sf_dir).where("split = 'train'"), "train")
    return in_sample_order(rows, SEED).select("row_id", F.col("position").cast("long"), *digest(F.col("question"), "question"))


@check(
    "prepared_from_configuration",
    sql.questions(
        f"SELECT split, row_id, answer AS answers, {digest_sql('question', 'question')} FROM "
        "(SELECT * FROM s UNION ALL SELECT * FROM d WHERE split = 'test')",
        _DEDUPED,
        "t AS (SELECT * FROM d WHERE split = 'train')",
        f"s AS ({_fraction_sql('t', FRACTION)})",
    ),
)
def prepared_from_configuration(spark, sf_dir):
    """Stored splits, with options from a configuration's mapping and an override."""
    path = scratch_path(spark, "questions")
    write_splits(fixtures.questions(spark, sf_dir), path)
    config = {"reasoning": {"dataset": {"path": path, "system_prompt": "x", "subset_fraction": 0.9}, "random_seed": SEED}}
    options = Options.from_mapping(merge(config, {"reasoning": {"dataset": {"subset_fraction": FRACTION}}}))
    train, test = prepare_from(spark, options)
    both = train.unionByName(test)
    return both.select("split", "row_id", "answers", *digest(last_content(F.col("prompt")), "question"))


# The lexicon of the check is written out on its own.
_VOTES = {
    "de": "auf das den der die ein eine ist mit nicht sich und von zu",
    "en": "and are as by for in is it of that the this to with",
    "es": "con del el en es las los para por que se un una y",
    "fr": "avec dans des du est et la le les pour qui sur un une",
}
_VOTE_SQL = {
    code: f"len(list_intersect(words, string_split('{words}', ' ')))" for code, words in _VOTES.items()
}


@check(
    "language_agreement",
    "WITH w AS (SELECT lang, list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS words FROM documents), "
    f"v AS (SELECT lang, {', '.join(f'{x} AS {c}' for c, x in _VOTE_SQL.items())} FROM w), "
    "g AS (SELECT lang, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'en' WHEN de = greatest(de, en, es, fr) THEN 'de' "
    "WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS found FROM v) "
    "SELECT lang, found, count(*) AS n FROM g GROUP BY ALL",
)
def language_agreement(spark, sf_dir):
    """How often the vote of function words names the documents' language."""
    documents = fixtures.table(spark, sf_dir, "documents")
    return documents.groupBy("lang", detect_language(F.col("text")).alias("found")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------- rewards in training


_REWARD_CTES = rewards.CTES


def _named(specs) -> list[str]:
    return [spec["name"] for spec in specs]


_SHIPPED = ", ".join(rewards.reward_sql(n) for n in _named(SHIPPED_SPECS))
_TOTAL = " + ".join(f"coalesce({n}, 0) * {w}::DOUBLE" for n, w in zip(_named(SHIPPED_SPECS), WEIGHTS))
_SCORES = (
    *_REWARD_CTES,
    f"s AS (SELECT sample_id, repeat_id, {_SHIPPED} FROM x)",
    f"t AS (SELECT *, {_TOTAL} AS reward_total FROM s)",
)
SCORES_ORACLE = sql.rollouts(
    f"SELECT sample_id, repeat_id, {', '.join(_named(SHIPPED_SPECS))}, "
    "round(reward_total, 6) + 0.0::DOUBLE AS reward_total FROM t",
    *_SCORES,
)


@check("total_reward", SCORES_ORACLE)
def total_reward_query(spark, sf_dir):
    rollouts = fixtures.rollouts(spark, sf_dir)
    return rounded(score_rollouts(rollouts, SHIPPED_SPECS, WEIGHTS, **rewards.COLUMNS))


@check("total_reward_streamed", SCORES_ORACLE)
def total_reward_streamed(spark, sf_dir):
    written = materialize(
        fixtures.rollouts(spark, sf_dir).select(
            "sample_id", "repeat_id", "response", "ground_truth", "answer_only"
        ),
        "rollouts",
    )
    stream = spark.readStream.schema(written.schema).parquet(_folder_of(written))
    path = scratch_path(spark, "streamed")
    checkpoint = scratch_path(spark, "streamed-offsets")
    write_scores(
        stream, SHIPPED_SPECS, path, checkpoint, WEIGHTS, once=True, **rewards.COLUMNS
    ).awaitTermination()
    return rounded(spark.read.parquet(path))


def _folder_of(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0]


@check(
    "group_advantage",
    sql.rollouts(
        "SELECT t.sample_id, repeat_id, round(reward_total, 6) + 0.0::DOUBLE AS reward_total, "
        "round((reward_total - m) / (sd + 0.0001::DOUBLE), 4) + 0.0::DOUBLE AS advantage FROM t JOIN "
        "(SELECT sample_id, avg(reward_total) AS m, coalesce(stddev_samp(reward_total), 0) AS sd "
        "FROM t GROUP BY sample_id) g ON g.sample_id = t.sample_id",
        *_SCORES,
    ),
)
def group_advantage_query(spark, sf_dir):
    rollouts = fixtures.rollouts(spark, sf_dir)
    scored = advantages(rollouts, SHIPPED_SPECS, WEIGHTS, **rewards.COLUMNS)
    return scored.select(
        "sample_id",
        "repeat_id",
        F.round("reward_total", 6).alias("reward_total"),
        F.round("advantage", 4).alias("advantage"),
    )


@check(
    "group_advantage_hot_sample",
    sql.rollouts(
        "SELECT t.sample_id, t.repeat_id, round((reward_total - m) / (sd + 0.0001::DOUBLE), 4) + 0.0::DOUBLE AS advantage FROM "
        "(SELECT t.*, lang FROM t JOIN r USING (sample_id, repeat_id)) t JOIN (SELECT lang, avg(reward_total) AS m, "
        "coalesce(stddev_samp(reward_total), 0) AS sd FROM t JOIN r USING (sample_id, repeat_id) GROUP BY lang) g ON g.lang = t.lang",
        *_SCORES,
    ),
)
def group_advantage_hot_sample(spark, sf_dir):
    """Advantage within few large groups, the largest with most of the rows."""
    rollouts = fixtures.rollouts(spark, sf_dir)
    scores = score_rollouts(rollouts, SHIPPED_SPECS, WEIGHTS, keep=["sample_id", "repeat_id", "lang"], **rewards.COLUMNS)
    scored = group_advantage(materialize(scores, "scores"), group="lang")
    return scored.select("sample_id", "repeat_id", F.round("advantage", 4).alias("advantage"))


@check("group_advantage_stored", ORACLES["group_advantage"])
def group_advantage_stored(spark, sf_dir):
    scores = score_rollouts(fixtures.rollouts(spark, sf_dir), SHIPPED_SPECS, WEIGHTS, keep=["sample_id", "repeat_id"], **rewards.COLUMNS)
    scored = with_group_advantage(_stored(materialize(scores, "scores"), "scores"))
    return scored.select("sample_id", "repeat_id", F.round("reward_total", 6).alias("reward_total"), F.round("advantage", 4).alias("advantage"))


@check("group_advantage_streamed", ORACLES["group_advantage"])
def group_advantage_streamed(spark, sf_dir):
    """Completions that arrive in two parts, the query restarted in between; every sample gets complete with the second."""
    scores = materialize(score_rollouts(fixtures.rollouts(spark, sf_dir), SHIPPED_SPECS, WEIGHTS, **rewards.COLUMNS), "scores")
    source, out, state = (scratch_path(spark, name) for name in ("arriving", "advantages", "state"))
    for part in (0, 1):
        scores.where(F.col("repeat_id") % 2 == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(scores.schema).parquet(source)
        write_advantages(stream, out, state, once=True, num_repeats=fixtures.REPEATS, patience_ms=86_400_000).awaitTermination()
    found = spark.read.parquet(out).where("is_complete")
    return found.select("sample_id", "repeat_id", F.round("reward", 6).alias("reward_total"), F.round("advantage", 4).alias("advantage"))


@check("group_advantage_stored_hot_sample", ORACLES["group_advantage_hot_sample"])
def group_advantage_stored_hot_sample(spark, sf_dir):
    """The same where some groups have more rows than a bucket should."""
    scores = score_rollouts(fixtures.rollouts(spark, sf_dir), SHIPPED_SPECS, WEIGHTS, keep=["sample_id", "repeat_id", "lang"], **rewards.COLUMNS)
    scored = with_group_advantage(_stored(materialize(scores, "scores"), "scores", key="lang", within="sample_id"))
    return scored.select("sample_id", "repeat_id", F.round("advantage", 4).alias("advantage"))


_TRAINING = _named(TRAINING_SPECS)


@check(
    "reward_report",
    sql.rollouts(
        " UNION ALL ".join(
            f"SELECT '{n}' AS reward, count({n}) AS scored, round(avg({n}), 6) + 0.0::DOUBLE AS mean, "
            f"round(stddev_samp({n}), 6) + 0.0::DOUBLE AS stddev, round(min({n}), 6) + 0.0::DOUBLE AS min, round(max({n}), 6) + 0.0::DOUBLE AS max, "
            f"round(count(*) FILTER (WHERE {n} <> 0) / count({n}), 6) AS share_nonzero FROM s"
            for n in _TRAINING
        ),
        *_REWARD_CTES,
        f"s AS MATERIALIZED (SELECT {', '.join(rewards.reward_sql(n) for n in _TRAINING)} FROM x)",
    ),
)
def reward_report_query(spark, sf_dir):
    scores = score(fixtures.rollouts(spark, sf_dir), TRAINING_SPECS, keep=[], **rewards.COLUMNS)
    return rounded(reward_report(rounded(scores), _TRAINING))


@check(
    "all_rewards",
    sql.rollouts(
        f"SELECT sample_id, repeat_id, {', '.join(rewards.reward_sql(n) for n in rewards.ARGS)} FROM x",
        *_REWARD_CTES,
    ),
)
def all_rewards(spark, sf_dir):
    rollouts = fixtures.with_class_scores(fixtures.rollouts(spark, sf_dir))
    return rounded(
        score(rollouts, rewards.SPECS, keep=["sample_id", "repeat_id"], **rewards.COLUMNS)
    )
