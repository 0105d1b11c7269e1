"""String expressions against Python's own string functions and regexes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rewardloom.functions import parse, text
from rewardloom.functions.text import SPACE

PIECES = [
    "<answer>", "</answer>", "<confidence>", "</confidence>", "<r>", "</r>", "<ANSWER>", "A", "b) no",
    "57", "100", "101", " 7 ", "1.5%", " ", "\n", "\t", "\x1c", "\x85", " ", " ", " ",
    "\r", "é", "😀", "ß", "x" * 60, "",
]


def random_texts(seed, n=3000, most=12):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, most))) for _ in range(n)]


def evaluate(spark, texts, **columns):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    rows = df.select("i", *[v.alias(k) for k, v in columns.items()]).orderBy("i").collect()
    return rows


def test_against_python(spark):
    c = F.col("c")
    texts = random_texts(1)
    rows = evaluate(
        spark,
        texts,
        strip=text.strip(c),
        word=text.first_word(c),
        before=text.before_first(c, "<answer>"),
        after=text.after_last(c, "</answer>"),
        n=text.occurrences(c, "<answer>"),
        nn=text.occurrences(c, "xx"),
        once=text.occurs_once(c, "</answer>"),
        once_x=text.occurs_once(c, "x" * 60),
        tail_x=text.after_last_token(c, "xxx"),
        pair=text.has_pair(c, "answer"),
    )
    for value, row in zip(texts, rows):
        expected = {
            "strip": value.strip(),
            "word": (value.split() or [""])[0],
            "before": value.split("<answer>")[0],
            "after": value.split("</answer>")[-1],
            "n": value.count("<answer>"),
            "nn": value.count("xx"),
            "once": value.count("</answer>") == 1,
            "once_x": value.count("x" * 60) == 1,
            "tail_x": value.split("xxx")[-1],
            "pair": all(t in value for t in ("<answer>", "</answer>")),
        }
        found = row.asDict()
        found.pop("i")
        assert found == expected, repr(value)


# Text, last tagged answer, confidence, text up to the answer, evaluated answer, whether parsed; worked out by hand.
PARSED = [
    ("<answer>A</answer>", "A", None, "<answer>", "A", True),
    ("x <answer> b) no </answer> y", "b) no", None, "x <answer>", "b) no", True),
    ("<answer>A</answer><answer>B</answer>", "B", None, "<answer>", "A", True),
    ("</answer>B<answer>A", "A", None, "</answer>B<answer>", "A", True),
    ("<answer></answer>", "", None, "<answer>", "", True),
    ("<answer>A", "A", None, "<answer>", "<answer>A", True),
    ("A</answer>B", "A", None, None, "A</answer>B", True),
    ("  plain\n", "plain", None, None, "plain", True),
    ("", "", None, None, "", False),
    (" \t", "", None, None, "", False),
    ("x" * 200, "x" * 200, None, None, "x" * 200, True),
    ("x" * 201, "x" * 201, None, None, "x" * 201, False),
    ("<confidence>57</confidence><answer>C</answer>", "C", 0.57, "<confidence>57</confidence><answer>", "C", True),
    ("<confidence> 7 </confidence>", "<confidence> 7", 0.07, None, "<confidence> 7 </confidence>", True),
    ("<confidence>100</confidence>", "<confidence>100", 1.0, None, "<confidence>100</confidence>", True),
    ("<confidence>101</confidence>", "<confidence>101", None, None, "<confidence>101</confidence>", True),
    ("<confidence>1.5%</confidence>", "<confidence>1.5%", None, None, "<confidence>1.5%</confidence>", True),
    ("<confidence>5", "<confidence>5", None, None, "<confidence>5", True),
    ("</confidence><confidence>9", "</confidence><confidence>9", 0.09, None, "</confidence><confidence>9", True),
    ("<confidence>0</confidence><confidence>9</confidence>", "<confidence>0</confidence><confidence>9</confidence>", 0.0, None, "<confidence>0</confidence><confidence>9</confidence>", True),
]


def test_parsing_table(spark):
    c = F.col("c")
    rows = evaluate(
        spark,
        [p[0] for p in PARSED],
        last=parse.last_tagged(c, "answer"),
        confidence=parse.strict_confidence(c),
        probe=parse.answer_probe(c),
        evaluated=parse.evaluated_answer(c),
        parsed=parse.is_parsed(c),
    )
    for case, row in zip(PARSED, rows, strict=True):
        # The last tagged answer of a text without tags is the text up to a closing one.
        assert tuple(row)[2:] == case[2:], case[0]
        if "answer" in case[0]:
            assert row["last"] == case[1], case[0]


def test_numbers_as_python_writes_them(spark):
    from pyspark.sql import types as T

    rng = random.Random(4)
    numbers = [0.0005, 12345678.9, 1e16, 1e-5, -2.5e-7, 57.0, 1e7, 0.0, -0.0, 1e100, 1.5e-120, 123456789012345680.0, 9999999.0, 0.001, 1e15, 2e-4]
    # Java 17 writes some doubles with a digit more than needed; these are not among them.
    numbers += [float(f"{rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-12, 15):.5e}") for _ in range(500)] + [float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, c double")
    rows = df.select("i", text.as_text(F.col("c"), T.DoubleType()).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [str(x) for x in numbers]
    for kind in (T.ArrayType(T.StringType()), T.StructType(), T.MapType(T.StringType(), T.StringType())):
        with pytest.raises(ValueError):
            text.as_text(F.col("c"), kind)


def test_split_in_order_equals_the_regex(spark):
    """Successive first matches find what the single lazy pattern finds."""
    tags = ["r", "answer"]
    joints = [parse.opening("r"), f"{parse.closing('r')}{SPACE}*{parse.opening('answer')}", parse.closing("answer")]
    pattern = re.compile(r"<r>(.*?)</r>\s*<answer>(.*?)</answer>", re.DOTALL)
    rng = random.Random(2)
    pieces = [f"<{t}>" for t in tags] + [f"</{t}>" for t in tags] + ["a", " ", "\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(4, 24))) for _ in range(5000)]
    matched, groups = parse.split_in_order(F.col("c"), joints)
    rows = evaluate(spark, texts, m=matched, a=groups[0], b=groups[1])
    hits = 0
    for value, row in zip(texts, rows):
        match = pattern.search(value)
        hits += bool(match)
        assert row["m"] == bool(match), repr(value)
        if match:
            assert (row["a"], row["b"]) == match.groups(), repr(value)
    assert hits > 100


def test_three_blocks_equal_the_regex(spark):
    from rewardloom.operators.scoring import score

    pattern = re.compile(r"<p>(.*?)</p>\s*<q>(.*?)</q>\s*<answer>(.*?)</answer>", re.DOTALL)
    rng = random.Random(3)
    pieces = ["<p>", "</p>", "<q>", "</q>", "<p>", "</p><q>", "</q>\n<answer>", "<answer>", "</answer>", "a", " "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 16))) for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, completion string")
    spec = {"name": "modular_step_format", "args": {"step_names": ["p", "q"], "min_step_lengths": [1, 2]}}
    rows = {r["i"]: r["modular_step_format"] for r in score(df, [spec], keep=["i"]).collect()}
    seen = set()
    for i, value in enumerate(texts):
        match = pattern.search(value)
        expected = 0.0
        if match:
            p, q, answer = (len(g.strip()) for g in match.groups())
            expected = 1.0 if p >= 1 and q >= 2 and answer >= 1 else 0.3
        seen.add(expected)
        assert rows[i] == expected, repr(value)
    assert seen == {0.0, 0.3, 1.0}


def test_repeated_blocks_do_not_overflow(spark):
    from rewardloom.operators.scoring import score

    df = spark.createDataFrame([("<thought>a</thought>" * 50_000 + "<answer>A</answer>",)], "completion string")
    assert score(df, ["multistep_format"]).first()["multistep_format"] == 1.0


def test_lenient_confidence(spark):
    def tagged(raw):
        return f"<confidence>{raw}</confidence>"

    cases = {tagged("1"): 1.0, tagged("150"): 1.5, tagged("-5"): 0.05, tagged("0.7"): 0.7, tagged("about 80%"): 0.8,
             tagged("none"): None, "<confidence>80": None, "80": None, tagged("3") + tagged("4"): 0.03}
    rows = evaluate(spark, list(cases), v=parse.lenient_confidence(F.col("c")))
    assert [r["v"] for r in rows] == list(cases.values())


def test_lettered_answer(spark):
    cases = {"<answer>A) Yes</answer>": "A", "<answer>because</answer>": "B", "<answer>Dunno</answer>": "Dunno", "": ""}
    rows = evaluate(spark, list(cases), v=parse.lettered_answer(F.col("c")))
    assert [r["v"] for r in rows] == list(cases.values())
