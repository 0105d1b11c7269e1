"""Substring dedup against all windows, and its edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from rewardloom.llm import repeats

COLUMNS = "doc_id long, text string, id long, n_words long, kept string"


def expected(rows):
    texts = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    key = lambda i: repeats.LAST if i is None else i
    least, own = {}, {}
    for d, (i, w) in enumerate(texts):
        for k in range(len(w) - repeats.WINDOW + 1):
            s = tuple(w[k : k + repeats.WINDOW])
            least[s] = min(least.get(s, key(i)), key(i))
            own.setdefault((d, s), k)
    out = []
    for d, (i, w) in enumerate(texts):
        gone = set()
        for k in range(len(w) - repeats.WINDOW + 1):
            s = tuple(w[k : k + repeats.WINDOW])
            if least[s] < key(i) or own[d, s] < k:
                gone |= set(range(k, k + repeats.WINDOW))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    words = ["".join(rng.choice("abCdé") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [prose(n) for n in (19, 20, 21, 29, 30, 45, 300)]
    out = [None, "", " \n\t", "one", " ".join(prose(19)), "x" * 50_000, "a b " * 5_000]
    for i in range(160):
        w = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        if i % 6 == 0 and w:
            out += [" ".join(w)] * rng.randint(1, 4)
            w[rng.randrange(len(w))] = "changed"
        out.append(rng.choice([" ", "\n", "\t\v"]).join(w))
    # A block of ten words that is common, with different words around it.
    block = prose(10)
    out += [" ".join(prose(15) + block + prose(15)) for _ in range(60)]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    rows = [(i, t, 1, 2, "own") for i, t in zip(ids, out, strict=True)]
    return [*rows, rows[40], rows[40], (None, rows[41][1], 0, 0, ""), (None, " ".join(prose(40)), 0, 0, ""), (3, " ".join(passages[-1]), 0, 0, "")]


def found(df):
    out = Counter()
    for r in repeats.without_repeats(df).collect():
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed"])
        # Maximal: spans neither touch nor overlap.
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))
        out[r["id"], r["n_words"], r["n_removed"], r["kept"]] += 1
    return out


@pytest.mark.parametrize("chars, windows", [(6_000_000, 4_000_000), (3_000, 2_000)])
def test_against_all_windows(spark, rows, monkeypatch, chars, windows):
    monkeypatch.setattr(repeats, "CHUNK_CHARS", chars)
    monkeypatch.setattr(repeats, "PARTITION_WINDOWS", windows)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert found(df) == expected([(r["doc_id"], r["text"]) for r in df.collect()])


def test_empty_tables(spark, rows):
    assert not found(spark.createDataFrame([], COLUMNS))
    blank = spark.createDataFrame([(1, None, 0, 0, ""), (2, "", 0, 0, "")], COLUMNS)
    assert found(blank) == Counter({(1, 0, 0, ""): 1, (2, 0, 0, ""): 1})


def test_blocks_that_share_a_hash_remove_nothing(spark, rows, monkeypatch):
    """With very few bits every window is a candidate; the comparison of whole windows decides."""
    monkeypatch.setattr(repeats, "SPARE_BITS", -100)
    df = spark.createDataFrame(rows[:80], COLUMNS)
    assert found(df) == expected([(r["doc_id"], r["text"]) for r in df.collect()])


def test_a_hot_passage_is_asked_for_once_per_chunk(spark):
    """However many documents share a passage, partitions get it once from each chunk."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, text) for i in range(2_000)], "doc_id long, text string").coalesce(2)
    chunks = repeats.chunks_of(df, "doc_id", "text")
    asked = repeats._probes(chunks, 32, 4).selectExpr("sum(n) AS n").first()["n"]
    assert asked <= 51 * chunks.count()
    assert sum(n for (i, *_), n in found(df).items() if i) == 1_999
