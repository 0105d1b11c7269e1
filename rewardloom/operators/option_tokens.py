"""Option probabilities from what a model gives for the next token.

A model server returns the likeliest next tokens with their log probabilities, as a map from token id. An option may be spelled by several
tokens (with and without a blank before it), so its log probability is the log of the sum over its spellings. An option none of whose
spellings is among the likeliest has no number, and ``option_probabilities`` then gives all options the uniform one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rewardloom.operators.rollouts import option_probabilities
from rewardloom.schemas import OPTIONS

# How vocabularies write a blank before a piece, or the end of a word.
MARKS = ("{}", "Ġ{}", "▁{}", "{}</w>")


def spellings(vocabulary: Mapping[str, int], options: Iterable[str] = OPTIONS) -> dict[str, list[int]]:
    """Ids of the tokens that spell each option, in order of id. An option without any is an error."""
    found = {option: sorted({vocabulary[m.format(option)] for m in MARKS if m.format(option) in vocabulary}) for option in options}
    if missing := [option for option, ids in found.items() if not ids]:
        raise ValueError(f"the vocabulary has no token for {', '.join(missing)}")
    return found


def vocabulary_of(spark: SparkSession, path: str) -> dict[str, int]:
    """Tokens and ids of a tokenizer file (JSON), read by Spark from wherever it is."""
    content = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    vocabulary = content["model"]["vocab"]
    # Unigram models list pairs of token and score, the id being the place.
    tokens = vocabulary if isinstance(vocabulary, dict) else {token: i for i, (token, _) in enumerate(vocabulary)}
    return {**tokens, **{t["content"]: t["id"] for t in content.get("added_tokens") or []}}


def log_probability(likeliest: Column, ids: Iterable[int]) -> Column:
    """Log of the summed probability of tokens in a map of log probabilities; NULL if none of them is there."""
    there = F.array_compact(F.array(*[F.try_element_at(likeliest, F.lit(i)) for i in ids]))

    def summed(values: Column) -> Column:
        top = F.array_max(values)
        return top + F.ln(F.aggregate(values, F.lit(0.0), lambda total, x: total + F.exp(x - top)))

    # Evaluated once, however often it is used.
    return F.transform(F.array(there), lambda v: F.when(F.size(v) > 0, summed(v)))[0]


def probabilities_of_likeliest(likeliest: Column, ids: Mapping[str, Iterable[int]], response: Column | None = None) -> dict[str, Column]:
    """``option_probabilities`` from a map of token ids to log probabilities; a NULL map has none."""
    return option_probabilities({option: log_probability(likeliest, tokens) for option, tokens in ids.items()}, response)
