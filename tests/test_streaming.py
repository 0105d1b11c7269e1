"""Scores of a stream equal scores of the table."""

from pyspark.sql import functions as F

from rewardloom.operators.advantage import group_advantage
from rewardloom.plans.scoring import score_rollouts
from rewardloom.streaming.groups import write_advantages
from rewardloom.streaming.online import write_scores

SPECS = ["right_answer_in_completion", {"name": "length", "args": {"optimal_length": 10}}, "confidence_provision"]
SCHEMA = "sample_id long, repeat_id int, completion string, answers string, answer_only boolean"


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, 0, f"<answer>{'ABC'[i % 3]}</answer>" if i % 4 else None, "A", i % 5 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    source, out, offsets = (str(tmp_path / name) for name in ("in", "out", "offsets"))
    expected = []
    for low in (0, 20):
        # Each run picks up what arrived since the last one.
        part = df.where(F.col("sample_id").between(low, low + 19))
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        write_scores(stream, SPECS, out, offsets, once=True).awaitTermination()
        expected += score_rollouts(part, SPECS).collect()
        found = spark.read.parquet(out).collect()
        assert sorted(found, key=lambda r: r["sample_id"]) == sorted(expected, key=lambda r: r["sample_id"])


def runner(spark, folder, **settings):
    """Adds rows to a stream's source and runs the query until they are dealt with."""
    source, out, state = (str(folder / name) for name in ("in", "out", "state"))
    schema = "sample_id long, repeat_id int, reward_total double"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        write_advantages(spark.readStream.schema(schema).parquet(source), out, state, once=True, num_repeats=4, **settings).awaitTermination()
        return spark.read.parquet(out)

    return run


def advantages(rows):
    return sorted((r["sample_id"], r["repeat_id"], round(r["advantage"], 9)) for r in rows)


def test_advantages_of_a_stream(spark, tmp_path):
    """Complete samples as in a table, over a restart; repeated rows once; late ones marked."""
    run = runner(spark, tmp_path)
    rows = [(i, k, float((i * 7 + k * k) % 5)) for i in range(30) for k in range(4)]
    first = [r for r in rows if (r[0] + r[1]) % 3 == 0] + [(None, 1, 1.0), (1, None, 1.0), (1, 0, None)]
    assert run(first + first[:9]).isEmpty()
    # Three samples stay open.
    rest = [r for r in rows if (r[0] + r[1]) % 3 and r[:2] not in ((3, 1), (4, 0), (5, 2))]
    found = run(rest + first[:5])
    whole = spark.createDataFrame([r for r in rows if r[0] not in (3, 4, 5)], "sample_id long, repeat_id int, reward_total double")
    assert advantages(found.where("NOT is_late").collect()) == advantages(group_advantage(whole).collect())
    assert found.where("NOT is_complete AND NOT is_late").isEmpty()
    late = found.where("is_late").count()
    found = run([(9, 0, 1.0), (9, 7, 1.0), (3, 1, 0.0)])
    assert found.where("is_late").count() == late + 2 and found.where("is_late AND advantage IS NOT NULL").isEmpty()
    assert found.where("sample_id = 3 AND is_complete").count() == 4


def test_incomplete_samples_of_a_stream(spark, tmp_path):
    """After their time, samples get the advantages of what is there; a sample of one gets 0."""
    run = runner(spark, tmp_path, patience_ms=1, memory_ms=3_600_000)
    rows = [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 4.0), (2, 3, 5.0)]
    run(rows)
    found = run([(3, 0, 1.0)])
    table = spark.createDataFrame(rows, "sample_id long, repeat_id int, reward_total double")
    assert advantages(found.where("sample_id < 3").collect()) == advantages(group_advantage(table).collect())
    assert found.where("is_complete OR is_late").isEmpty()
    assert run([(1, 3, 1.0)]).where("is_late").count() == 1


def test_a_sample_takes_one_read_and_one_write_of_state():
    """Each access is a request to the JVM, whatever the number of rows."""
    from rewardloom.streaming.groups import Groups

    class Fake:
        def __init__(self):
            self.value, self.calls = None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, at):
            self.calls.append("register")

        def deleteTimer(self, at):
            self.calls.append("delete")

        def getCurrentProcessingTimeInMs(self):
            return 5

    fake, groups = Fake(), Groups(4, 10, 100, 1e-4)
    groups.init(fake)
    row = lambda i: {"repeat_id": i, "reward": float(i)}
    assert list(groups.handleInputRows((7,), [row(0), row(1), row(1)], fake)) == []
    assert fake.calls == ["get", "register", "update"]
    assert len(list(groups.handleInputRows((7,), [row(2), row(3), row(3)], fake))) == 5
    assert fake.calls[3:] == ["get", "delete", "register", "update"] and fake.value == (105, True, [], [])
