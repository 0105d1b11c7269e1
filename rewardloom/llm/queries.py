"""The registered queries of this package and their check SQL."""

from __future__ import annotations

import importlib

#: Modules of the operators.
MODULES = ["quality", "secrets", "decontaminate", "bpe", "jaccard", "sharding", "urls", "backoff", "toxicity", "editing", "merkle", "centroids", "repeats"]

QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _module = importlib.import_module(f"rewardloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
