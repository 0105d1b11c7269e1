"""Evaluate rollouts and store the results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rewardloom.operators.evaluate import evaluate_responses, result_rows, summarize
from rewardloom.scratch import materialize
from rewardloom.sources.results import write_csv, write_json, write_summary


def evaluate_and_store(
    rollouts: DataFrame,
    path: str,
    *,
    by: list[str] | None = None,
    samples: DataFrame | None = None,
    compression: str = "gzip",
    **columns,
) -> DataFrame:
    """Write ``results_json``, ``results_csv`` and ``summary`` under ``path``.

    Responses are judged once; the three outputs are made from the written
    result. JSON and CSV repeat every text and are compressed (``none`` for plain
    files). Returns the summary.
    """
    evaluated = materialize(evaluate_responses(rollouts, carry=by, **columns), "evaluated")
    results = result_rows(evaluated)
    write_json(results, f"{path}/results_json", compression=compression)
    write_csv(results, f"{path}/results_csv", compression=compression)
    summary = summarize(evaluated, by, samples)
    write_summary(summary, f"{path}/summary")
    return summary
