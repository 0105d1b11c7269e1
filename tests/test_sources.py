"""Splits, Arrow shards, result files and the shared folder."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rewardloom.options import DatasetOptions
from rewardloom.scratch import SETTING, materialize, shared_folder
from rewardloom.sources import arrow_shards
from rewardloom.sources.results import read_csv, read_json, write_csv, write_json, write_summary
from rewardloom.sources.splits import load_sft_table, load_split, load_splits, write_splits

AWKWARD = ["", None, 'a"b', "a\nb", "a\r\nb", " lead and trail ", "x,y", '\\"q\\', '"', "\r", "a\\", '""', " z",
           "#c", "\t", "'", "é😀", "null", "\\N", "<answer>\n\"A\", B</answer>\n"]


def results(spark):
    rows = [(i, 0, text, text, "A", text, True, False, None if i % 2 else 0.5, 1 / 3, None, 1e-9) for i, text in enumerate(AWKWARD)]
    from rewardloom.schemas import RESULT_SCHEMA

    return spark.createDataFrame(rows, RESULT_SCHEMA)


@pytest.mark.parametrize("write, read", [(write_csv, read_csv), (write_json, read_json)])
def test_results_survive(spark, tmp_path, write, read):
    df = results(spark)
    write(df, str(tmp_path / "out"))
    found = read(spark, str(tmp_path / "out")).orderBy("sample_id").collect()
    assert found == df.orderBy("sample_id").collect()


def test_repeated_long_texts_are_stored_once(spark, tmp_path):
    """Few-shot prompts of 100 KB come once for each repeat; within gzip's 32 KB none is found again."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1_600)), lambda x: F.sha2(F.concat_ws("-", "id", x), 256)))
    df = spark.range(6).select("id", text.alias("full_prompt"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("repeat_id")).coalesce(1)
    write_json(df, str(tmp_path / "out"), compression="zstd", rows_per_file=40)
    files = [x for x in (tmp_path / "out").iterdir() if x.name.startswith("part-")]
    assert len(files) == 2 and sum(x.stat().st_size for x in files) < 700_000
    found = read_json(spark, str(tmp_path / "out"), df.schema)
    assert sorted(found.collect()) == sorted(df.collect())


@pytest.mark.parametrize("size", ["50", "300", "128m"])
def test_csv_by_ranges(spark, tmp_path, size):
    """Ranges that end anywhere, also within quotes and within one long value, give the rows of a whole file."""
    from rewardloom.sources import quoted_csv
    from rewardloom.sources.results import CSV_OPTIONS

    long = [(900, 0, "x,\n\"y\"\n" * 60, "p", "A", "\n\n", True, False, None, 0.5, None, 1e-9)]
    df = results(spark).unionByName(spark.createDataFrame(long, results(spark).schema))
    write_csv(df.coalesce(2), str(tmp_path / "out"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = sorted(read_csv(spark, str(tmp_path / "out"), by_ranges=True).collect(), key=lambda r: r["sample_id"])
        n_ranges = quoted_csv.ranges(quoted_csv._lines(spark, str(tmp_path / "out"))).count()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(quoted_csv, "FEW_RANGES", 0)
            again = sorted(read_csv(spark, str(tmp_path / "out"), by_ranges=True).collect(), key=lambda r: r["sample_id"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    options = {**CSV_OPTIONS, "emptyValue": "", "nullValue": "\0", "multiLine": True}
    whole = spark.read.schema(df.schema).options(**options).csv(str(tmp_path / "out")).orderBy("sample_id").collect()
    assert found == whole == df.orderBy("sample_id").collect() and again == found
    assert n_ranges > 4 or size == "128m"


@pytest.mark.parametrize("range_bytes", ["100", "1m"])
def test_compressed_csv_by_ranges(spark, tmp_path, monkeypatch, range_bytes):
    """A file of many frames is read by several tasks, by Spark's reader as a whole, and is far smaller than its text."""
    from rewardloom.sources import framed, quoted_csv

    monkeypatch.setattr(framed, "FRAME_BYTES", 300)
    repeats = results(spark).withColumn("repeat_id", F.explode(F.sequence(F.lit(0), F.lit(7))))
    long = [(900, r, "x,\n\"y\"\n" * 500, "p", "A", "\n\n", True, False, None, 0.5, None, 1e-9) for r in range(8)]
    df = repeats.unionByName(spark.createDataFrame(long, results(spark).schema)).coalesce(2)
    path = str(tmp_path / "out")
    write_csv(df, path, compression="zstd", rows_per_file=0)
    files = [x for x in (tmp_path / "out").iterdir() if x.suffix == ".zstd"]
    assert 1 <= len(files) <= 2 and not [x for x in (tmp_path / "out").iterdir() if x.name.startswith(".part") and x.suffix == ".zstd"]
    with pytest.raises(ValueError, match="exists"):
        write_csv(df, path, compression="zstd", rows_per_file=0)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    try:
        found = read_csv(spark, path, by_ranges=True)
        n_ranges = quoted_csv.ranges(quoted_csv._lines(spark, path)).count()
    finally:
        # Read after the setting is another one again.
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    order = lambda rows: sorted(rows, key=lambda r: (r["sample_id"], r["repeat_id"]))
    expected = order(df.collect())
    assert order(found.collect()) == expected == order(read_csv(spark, path).collect())
    assert n_ranges > 10 if range_bytes == "100" else n_ranges == len(files)
    write_csv(df, path, mode="append", compression="zstd", rows_per_file=50)
    assert read_csv(spark, path, by_ranges=True).count() == 2 * len(expected)
    write_csv(df.limit(0), path, mode="overwrite", compression="zstd")
    assert read_csv(spark, path, by_ranges=True).collect() == []
    write_csv(df, str(tmp_path / "large"), compression="zstd", rows_per_file=0)
    write_csv(df, str(tmp_path / "plain"), rows_per_file=0)
    stored, plain = (sum(x.stat().st_size for x in (tmp_path / name).iterdir() if x.name.startswith("part-")) for name in ("large", "plain"))
    assert stored * 2 < plain


@pytest.mark.parametrize("write, read", [(write_csv, read_csv), (write_json, read_json)])
def test_result_files_are_bounded(spark, tmp_path, write, read):
    """One task's rows go to several compressed files, and come back as they were."""
    df = results(spark).coalesce(1)
    write(df, str(tmp_path / "out"), compression="gzip", rows_per_file=6)
    assert len(list((tmp_path / "out").glob("part-*.gz"))) == -(-len(AWKWARD) // 6)
    assert read(spark, str(tmp_path / "out")).orderBy("sample_id").collect() == df.orderBy("sample_id").collect()


def test_csv_that_ends_within_quotes(spark, tmp_path):
    from rewardloom.sources.quoted_csv import read_quoted

    (tmp_path / "a.csv").write_text('n,t\n1,"x\ny"\n2,"z\n')
    with pytest.raises(Exception, match="ends within quotes"):
        read_quoted(spark, str(tmp_path / "a.csv"), "n int, t string", header=True, escape='"').collect()
    (tmp_path / "b.csv").write_text('"n\nn",t\n1,"x\ny"\n\n2,z')
    assert [tuple(r) for r in read_quoted(spark, str(tmp_path / "b.csv"), "n int, t string", header=True, escape='"').orderBy("n").collect()] == [(1, "x\ny"), (2, "z")]


def test_csv_header_order(spark, tmp_path):
    df = results(spark)
    write_csv(df.select(*reversed(df.columns)).coalesce(1), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*.csv")
    assert file.read_text(encoding="utf-8").split("\n")[0] == (
        "sample_id,repeat_id,question,predicted_answer,ground_truth,full_response,parsed_successfully,"
        "is_correct,confidence_score,answer_prob_A,answer_prob_B,answer_prob_C"
    )


def test_summary_keeps_its_tasks(spark, tmp_path):
    """Groups are not brought into one task; an ungrouped summary is one anyway."""
    write_summary(spark.range(5).repartition(5), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.json"))) > 1
    write_summary(spark.range(50).agg(F.count("*").alias("n")), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.json"))) == 1


def test_splits(spark, tmp_path, plan):
    path = str(tmp_path / "table")
    df = spark.range(10).select(F.col("id").alias("row_id"), F.when(F.col("id") < 3, "test").otherwise("train").alias("split"))
    write_splits(df, path)
    train, test = load_splits(spark, DatasetOptions(path=path))
    assert (train.count(), test.count()) == (7, 3)
    assert "PartitionFilters: [isnotnull(split" in plan(test)
    assert load_split(spark, path).count() == 10
    with pytest.raises(ValueError, match="no split 'nope'"):
        load_split(spark, path, "nope")
    assert load_sft_table(spark, DatasetOptions(path=path)) is None
    assert load_sft_table(spark, DatasetOptions(sft_column="x", sft_dataset_path=path)).count() == 7
    flat = str(tmp_path / "flat")
    df.drop("split").write.parquet(flat)
    assert load_sft_table(spark, DatasetOptions(sft_column="x", sft_dataset_path=flat)).count() == 10


def write_shards(folder, tables):
    import pyarrow as pa

    folder.mkdir(parents=True)
    names = [f"data-{i:05d}-of-{len(tables):05d}.arrow" for i in range(len(tables))]
    for name, batches in zip(names, tables):
        with pa.OSFile(str(folder / name), "wb") as file, pa.ipc.new_stream(file, batches[0].schema) as stream:
            for batch in batches:
                stream.write_batch(batch)
    (folder / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names]}))


def test_arrow_shards(spark, tmp_path):
    import pyarrow as pa

    def batch(*questions):
        return pa.RecordBatch.from_pydict(
            {"question": pa.array(questions, pa.large_string()), "n": pa.array([len(q or "") for q in questions], pa.int32())}
        )

    write_shards(tmp_path / "train", [[batch("a", None), batch("bb")], [batch("c")]])
    write_shards(tmp_path / "test", [[batch("z")]])
    (tmp_path / "dataset_dict.json").write_text(json.dumps({"splits": ["train", "test"]}))
    arrow_shards.register(spark)
    reader = spark.read.format("arrow_shards")
    train = reader.option("split", "train").option("row_id", "row_id").load(str(tmp_path))
    assert train.dtypes == [("row_id", "bigint"), ("question", "string"), ("n", "int")]
    assert train.rdd.getNumPartitions() == 2
    rows = train.orderBy("row_id").collect()
    assert [(r["question"], r["n"]) for r in rows] == [("a", 1), (None, 0), ("bb", 2), ("c", 1)]
    assert len({r["row_id"] for r in rows}) == 4
    test = spark.read.format("arrow_shards").option("split", "test").load(str(tmp_path))
    assert [r["question"] for r in test.collect()] == ["z"]
    whole = spark.read.format("arrow_shards").load(str(tmp_path / "test"))
    assert whole.count() == 1
    dataset = DatasetOptions(path=str(tmp_path), format="arrow_shards", sft_column="question", sft_dataset_path=str(tmp_path))
    assert [t.count() for t in load_splits(spark, dataset)] == [4, 1]
    assert load_sft_table(spark, dataset).count() == 4
    flat = DatasetOptions(format="arrow_shards", sft_column="question", sft_dataset_path=str(tmp_path / "test"))
    assert [r["row_id"] for r in load_sft_table(spark, flat).collect()] == [0]
    with pytest.raises(ValueError, match="unknown dataset format"):
        load_splits(spark, DatasetOptions(path=str(tmp_path), format="csv"))
    with pytest.raises(Exception, match="no split"):
        spark.read.format("arrow_shards").option("split", "dev").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="is a split missing"):
        spark.read.format("arrow_shards").load(str(tmp_path)).count()


@pytest.fixture(scope="module")
def long_shards(tmp_path_factory):
    """Two shards: one of 40 record batches with compressed bodies, one with dictionaries that change between batches."""
    folder = tmp_path_factory.mktemp("shards")
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.OSFile(str(folder / "a.arrow"), "wb") as file:
        batches = [pa.RecordBatch.from_pydict({"text": pa.array([f"{i} {k} " + "x" * 500 for k in range(i % 7)], pa.string()), "n": pa.array([i] * (i % 7), pa.int64())}) for i in range(40)]
        with pa.ipc.new_stream(file, batches[0].schema, options=options) as stream:
            for batch in batches:
                stream.write_batch(batch)
    with pa.OSFile(str(folder / "b.arrow"), "wb") as file:
        words = [["u", "v"], ["u", "v", "w"], ["z"], ["z"]]
        coded = [pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays([0, len(d) - 1], d), pa.array([100 + i, 100 + i])], ["text", "n"]) for i, d in enumerate(words)]
        with pa.ipc.new_stream(file, coded[0].schema) as stream:
            for batch in coded:
                stream.write_batch(batch)
    write_state(folder, "a.arrow", "b.arrow")
    want = [(r["text"], r["n"]) for b in batches for r in b.to_pylist()]
    return folder, want + [(d[k], 100 + i) for i, d in enumerate(words) for k in (0, -1)]


@pytest.mark.parametrize("most", [1, 4_000, 1 << 30])
def test_runs_of_batches(spark, long_shards, most):
    """Runs of any size give the rows in order; small ones give many tasks."""
    folder, want = long_shards
    arrow_shards.register(spark)
    schema = "row_id long, text string, n long"
    df = spark.read.format("arrow_shards").schema(schema).option("row_id", "row_id").option("partition_bytes", str(most)).load(str(folder))
    rows = df.orderBy("row_id").collect()
    assert [(r["text"], r["n"]) for r in rows] == want
    assert [r["row_id"] for r in rows] == list(range(len(want)))
    tasks = df.rdd.getNumPartitions()
    assert (tasks == 44) if most == 1 else (5 < tasks < 44) if most == 4_000 else (tasks == 4)
    narrow = spark.read.format("arrow_shards").schema("n long").option("partition_bytes", str(most)).load(str(folder))
    assert sorted(r["n"] for r in narrow.collect()) == sorted(n for _, n in want)


def test_headers_say_what_readers_read(long_shards):
    """Rows and places by the headers alone, against the library's reader."""
    folder, want = long_shards
    for name in ("a.arrow", "b.arrow"):
        found = arrow_shards.batches_of(str(folder / name))
        with pa.OSFile(str(folder / name)) as file, pa.ipc.open_stream(file) as stream:
            assert [b.rows for b in found if b.kind == arrow_shards.RECORDS] == [b.num_rows for b in stream]
        assert found[0].kind == arrow_shards.SCHEMA and all(a.end == b.start for a, b in zip(found, found[1:]))
    assert sum(b.kind == arrow_shards.DICTIONARY for b in arrow_shards.batches_of(str(folder / "b.arrow"))) >= 2


def test_written_index(spark, long_shards, tmp_path):
    folder, want = long_shards
    index = arrow_shards.write_index(spark, str(folder), str(tmp_path / "index"))
    assert index.where("kind = 3").agg(F.sum("rows")).first()[0] == len(want)
    arrow_shards.register(spark)
    reader = spark.read.format("arrow_shards").schema("row_id long, text string, n long").option("row_id", "row_id").option("partition_bytes", "4000")
    rows = reader.option("index", str(tmp_path / "index")).load(str(folder)).orderBy("row_id").collect()
    assert [(r["text"], r["n"]) for r in rows] == want


def test_broken_shards(long_shards, tmp_path):
    content = (long_shards[0] / "a.arrow").read_bytes()
    (tmp_path / "cut.arrow").write_bytes(content[: len(content) // 2])
    with pytest.raises(ValueError, match="ends within a message"):
        arrow_shards.batches_of(str(tmp_path / "cut.arrow"))
    (tmp_path / "none.arrow").write_bytes(b"")
    with pytest.raises(ValueError, match="not an Arrow stream"):
        arrow_shards.batches_of(str(tmp_path / "none.arrow"))


class Session:
    """What the choice of the folder depends on."""

    def __init__(self, **settings):
        self.conf = settings


def test_shared_folder(tmp_path, monkeypatch):
    from rewardloom import scratch

    monkeypatch.setattr(scratch, "_WHERE_UNSET", [])
    assert shared_folder(Session(**{SETTING: f"{tmp_path}/"})) == str(tmp_path)
    with pytest.raises(RuntimeError, match="set spark.checkpoint.dir"):
        shared_folder(Session())
    scratch.use_where_unset("/shared/own")
    assert shared_folder(Session()) == "/shared/own"
    assert shared_folder(Session(**{SETTING: f"{tmp_path}/"})) == str(tmp_path)


def write_shard(folder, name, table):
    with pa.OSFile(str(folder / name), "wb") as file, pa.ipc.new_stream(file, table.schema) as stream:
        stream.write_table(table, max_chunksize=2)


def write_state(folder, *names):
    (folder / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names]}))


def test_shards_by_name(spark, tmp_path):
    write_shard(tmp_path, "a.arrow", pa.table({"question": ["q1", None, "q3"], "answer": ["A", "B", "C"], "n": [1, 2, None]}))
    write_shard(tmp_path, "b.arrow", pa.table({"n": [4], "answer": ["D"], "question": ["q4"]}))
    write_state(tmp_path, "a.arrow", "b.arrow")
    arrow_shards.register(spark)
    reader = spark.read.format("arrow_shards").option("row_id", "row_id")
    rows = reader.load(str(tmp_path)).orderBy("row_id").collect()
    assert [(r["question"], r["answer"], r["n"]) for r in rows] == [("q1", "A", 1), (None, "B", 2), ("q3", "C", None), ("q4", "D", 4)]
    ids = [r["row_id"] for r in rows]
    some = reader.option("columns", "n, answer").load(str(tmp_path))
    assert some.columns == ["row_id", "n", "answer"]
    for condition, expected in (("n > 1", "BD"), ("answer = 'A'", "A"), ("n IS NULL", "C"), ("n <= 2 AND answer >= 'B'", "B"), ("n = 1 OR answer = 'D'", "AD"), (f"row_id = {ids[3]}", "D")):
        assert "".join(r["answer"] for r in some.where(condition).orderBy("row_id").collect()) == expected, condition
    with pytest.raises(Exception, match="no column x"):
        reader.option("columns", "x").load(str(tmp_path)).count()


def test_shard_without_a_column(spark, tmp_path):
    write_shard(tmp_path, "a.arrow", pa.table({"question": ["q1"], "n": [1]}))
    write_shard(tmp_path, "b.arrow", pa.table({"question": ["q1"]}))
    write_state(tmp_path, "a.arrow", "b.arrow")
    arrow_shards.register(spark)
    with pytest.raises(Exception, match="no column 'n'"):
        spark.read.format("arrow_shards").load(str(tmp_path)).collect()


def test_no_shards(spark, tmp_path):
    write_state(tmp_path)
    arrow_shards.register(spark)
    with pytest.raises(Exception, match="has no shards"):
        spark.read.format("arrow_shards").load(str(tmp_path)).count()
    assert spark.read.format("arrow_shards").schema("question string").load(str(tmp_path)).count() == 0


def test_materialize(spark):
    copy = materialize(spark.range(5), "numbers")
    assert copy.count() == 5 and copy.schema.names == ["id"]
    assert f"{shared_folder(spark)}/rewardloom/numbers-" in copy.inputFiles()[0]


def test_parts_are_read_as_asked():
    """Parts of a file follow each other, and no more is held than was asked for."""
    import io

    parts = arrow_shards._Parts(io.BytesIO(b"0123456789"), [(0, 3), (6, 10)])
    assert [parts.read(2), parts.read(2), parts.read(0), parts.read(9), parts.read(1)] == [b"01", b"26", b"", b"789", b""]
