"""The corpus pipeline against its stages by brute force, and its edge cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rewardloom.llm import bpe, decontaminate, secrets
from rewardloom.scratch import materialize
from tests.llm.test_operators import base_measures, base_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with each thing the stages look for, and a benchmark."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    texts = [None, "", "too short"]
    for i in range(90):
        text = prose(rng.randint(40, 160))
        if i % 10 == 1:
            text += " " + items[i % 5][1]
        if i % 10 == 2:
            text += " password=b7db7aa4a5fcc78305"
        texts.append(text)
        if i % 9 == 0:
            texts += [text, text + " one"]
    texts.append("again and " * 60)
    rows = [(i, t, "en", "s", len(t or ""), "r", None) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        new = materialize(stage(spark, docs, folder), name)
        kept[name] = {r["doc_id"]: r for r in new.collect()}
        if name != "tokens":
            assert new.columns == docs.columns
        if name == "quality_rules":
            failed = {i for i, r in before.items() if base_measures(r["text"])[-1]}
            assert not failed & set(kept[name]) and len(kept[name]) > 0.95 * (len(before) - len(failed))
        if name == "near_duplicates":
            sets = {i: shingles(r["text"]) for i, r in before.items()}
            alike = lambda x, y: 100 * len(x & y) >= corpus_pipeline.NEAR_PERCENT * len(x | y)
            # Copies here come in families that link all with all.
            assert set(kept[name]) == {i for i in sets if not any(j < i and alike(sets[i], sets[j]) for j in sets)}
            assert len(kept[name]) < len(before)
        if name == "decontamination":
            items = decontaminate.Items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
            texts = [" ".join(words) for words in ([*decontaminate.words_of(r["text"])] for r in before.values())]
            leaking = {i for i, t in zip(before, texts, strict=True) if any(" ".join(decontaminate.words_of(x)) in t for x in benchmark(spark, folder))}
            assert leaking and set(kept[name]) == set(before) - leaking and all(items.matches(before[i]["text"]) for i in leaking)
        if name == "secret_redaction":
            assert set(kept[name]) == set(before)
            for i, r in kept[name].items():
                assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
                assert r["text"] == before[i]["text"] or "[secret]" in r["text"]
            assert any("[secret]" in r["text"] for r in kept[name].values())
        if name == "tokens":
            library = Tokenizer.from_file(bpe.tokenizer_path())
            for i, r in kept[name].items():
                ids = library.encode(before[i]["text"], add_special_tokens=False).ids
                assert r["ids"] == ids and r["n_tokens"] == len(ids)
                assert r["decoded_sha256"] == hashlib.sha256(before[i]["text"].encode()).hexdigest()
        docs = new
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, kept["tokens"].values()))


def shingles(text):
    words, size = (text or "").encode().lower().split(), corpus_pipeline.NEAR_WORDS
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def benchmark(spark, folder):
    return [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_scattered_words(spark, folder):
    """Two replaced words in a hundred: 0.81 alike by shingles of five words, 0.88 by three."""
    words = [f"w{i}" for i in range(100)]
    copy = [*words[:30], "other", *words[31:70], "other", *words[71:]]
    unlike = [*words[:20], "x", *words[21:40], "x", *words[41:60], "x", *words[61:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(unlike))], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()} == {1, 3}


def test_stages_call_the_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_redaction", "tokens"]
    assert secrets.KINDS[:3] == ["assign", "access", "hex"]
