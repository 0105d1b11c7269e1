"""Run a user's own text scorer, such as a classifier or a language detector.

The only place where rows go through Python, and only the one text column does,
in Arrow batches. No reward needs it: rewards read the column it adds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[list[str]], Sequence[Any]]


def score_texts(
    make_scorer: Callable[[], Scorer], text: Column, output: T.DataType | str
) -> Column:
    """The scorer's result for each text; NULL for a NULL text.

    ``make_scorer`` is called once per task, so that a model is loaded once and
    not per batch. The scorer gets a list of texts and returns one value each.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for batch in batches:
            present = batch.notna()
            values = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            texts = batch[present].tolist()
            if texts:
                values[present] = pd.Series(list(scorer(texts)), index=batch.index[present], dtype=object)
            yield values

    return F.pandas_udf(run, output)(text)
