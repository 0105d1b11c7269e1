"""URL filters by host word segmentation (operator 2).

Names in a host are often several words written as one. Their most likely split
under a unigram model is found by Viterbi; a multinomial naive Bayes model over the
segmented host and the path's tokens then scores each url. Listed rules decide first, the longest one.

The unigram counts are those of all words in the pages' visible text. Only the
substrings of distinct host labels are looked up in them, by a join. The naive Bayes model
is trained on all urls, labelled by seed words: a url whose segmented host has one
is an example to block, any other one to allow. Token counts and sums of logarithms are plain
aggregations over distinct names, so a host with a third of the pages costs as much as one row.

Defined results: urls that are NULL or have no ``://`` have an empty host and path
and get the verdict of the model's prior; equal urls get equal verdicts; an
empty table gives an empty result; other columns are ignored; ties between splits go to fewer, then to longer first
words; NULL html has no words.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm.common import column, table
from rewardloom.scratch import materialize

#: The listed rules, as (verdict, host/path): fixed values.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words that mark a host as an example to block.
SEEDS = "adult ads bet bets betting casino cheap farm free gambling loan loans pills poker porn sex spam track viagra win xxx".split()


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    letters = "".join(map(chr, range(65, 91)))
    return F.translate(host, letters, letters.lower())


def path_of(url: Column) -> Column:
    # The first "://" counts, whatever follows.
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else NULL."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def unigrams(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): counts of the words in the pages' visible text, A-Z lower-cased."""
    text = F.regexp_replace(F.coalesce(column(pages, html, "string"), F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def best_split(label: str, known: dict[str, int], total: int) -> list[str]:
    """The most likely split; an unknown word's probability falls tenfold with each letter."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(end):
            word = label[start:end]
            n = known.get(word)
            logp = math.log(n / total) if n else math.log(10.0 / max(total, 1)) - len(word) * math.log(10.0)
            before = best[start]
            options.append((before[0] + logp, -(before[1] + 1), start))
        score, words, start = max(options, key=lambda o: (round(o[0], 9), o[1], -o[2]))
        best.append((score, -words, start))
    out, end = [], len(label)
    while end:
        start = best[end][2]
        out.append(label[start:end])
        end = start
    return out[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) of distinct ``labels``: letters are split by Viterbi, other characters separate."""
    parts = labels.select("label", F.explode(F.array_remove(F.split("label", "[^a-z]+"), "")).alias("part")).select("part").distinct()
    # No piece is longer than the longest word that was counted.
    longest = counts.agg(F.coalesce(F.max(F.length("word")), F.lit(1)).alias("longest"))
    pieces = parts.join(longest, F.lit(True)).select("part", "longest", F.explode(F.expr("sequence(1, length(part))")).alias("start")).select(
        "part", "start", F.explode(F.expr("sequence(1, least(longest, length(part) - start + 1))")).alias("length")
    )
    pieces = pieces.select("part", F.expr("substring(part, start, length)").alias("word")).distinct()
    met = pieces.join(counts, "word").groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))

    @F.pandas_udf("array<string>")
    def split(part, known, total):
        import pandas as pd

        return pd.Series([best_split(p, {k["word"]: k["n"] for k in ks} if ks is not None else {}, t) for p, ks, t in zip(part, known, total, strict=True)])

    found = parts.join(met, "part", "left").join(total, F.lit(True)).select("part", split("part", "known", "total").alias("words"))
    each = labels.select("label", F.posexplode(F.array_remove(F.split("label", "[^a-z]+"), "")).alias("at", "part")).join(found, "part")
    return each.groupBy("label").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x.words)).alias("words"))


def naive_bayes(names: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``names`` (name, tokens, host_words, n) with ``log_odds`` of block against allow, add-one smoothed."""
    marked = names.withColumn("bad", F.arrays_overlap("host_words", F.array(*[F.lit(s) for s in seeds])).cast("int"))
    tokens = marked.select("name", "bad", "n", F.explode("tokens").alias("token"))
    model = tokens.groupBy("token").agg(F.sum(F.col("n") * F.col("bad")).alias("bad"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("good"))
    sums = model.agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.count("*").alias("vocabulary"))
    prior = marked.agg(F.expr("ln((sum(n * bad) + 1.0D) / (sum(n * (1 - bad)) + 1.0D))").alias("prior"))
    odds = model.join(sums, F.lit(True)).select(
        "token", F.expr("ln((bad + 1.0D) / (all_bad + vocabulary)) - ln((good + 1.0D) / (all_good + vocabulary))").alias("odds")
    )
    scores = tokens.join(odds, "token").groupBy("name").agg(F.sum("odds").alias("odds"))
    return names.join(scores, "name", "left").join(prior, F.lit(True), "left").select("name", F.expr("coalesce(odds, 0D) + coalesce(prior, 0D)").alias("log_odds"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: its key, host, path, fitting rule, verdict, the host's words and the model's log odds of block."""
    address = column(pages, url, "string")
    # Digits in paths are numbers of pages: one token for all of a length.
    shape = F.regexp_replace(F.lower("path"), "[0-9]", "0")
    rows = pages.select(F.col(f"`{key}`").alias(key), host_of(address).alias("host"), path_of(address).alias("path"))
    rows = rows.withColumn("name", F.concat_ws("|", "host", shape))
    names = materialize(rows.groupBy("name", "host", shape.alias("shape")).agg(F.count("*").alias("n")), "names")
    labels = names.select(F.explode(F.split("host", r"\.")).alias("label")).where("label <> ''").distinct()
    counts = materialize(unigrams(pages, html), "unigrams")
    split = segmented(labels, counts)
    hosts = names.select("host").distinct().select("host", F.posexplode(F.split("host", r"\.")).alias("at", "label")).join(split, "label")
    hosts = hosts.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x.words)).alias("host_words"))
    none = F.array().cast("array<string>")
    full = names.join(hosts, "host", "left").select(
        "name", "n", F.coalesce("host_words", none).alias("host_words"),
        F.concat(F.coalesce("host_words", none), F.transform(F.array_remove(F.split("shape", "[^a-z0-9]+"), ""), lambda x: F.concat(F.lit("/"), x))).alias("tokens"),
    )
    full = materialize(full, "tokens")
    scores = naive_bayes(full, seeds).join(full.select("name", "host_words"), "name")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(scores, "name").select(
        key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "host_words", "log_odds"
    )


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the verdict on every page's url."""
    return judged(table(spark, sf_dir, "pages"))


QUERIES = {"op2_url_filters": url_filters}
ORACLES: dict[str, str] = {}
