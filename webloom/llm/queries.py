"""The operators applied to their whole tables, one query each."""

from __future__ import annotations

import importlib

import corpus_pipeline
from webloom.llm.registry import ORACLES, QUERIES, query

MODULES = ["q_decontam", "q_exact", "q_langid", "q_line_dedup", "q_lm", "q_minhash", "q_packing", "q_phrases", "q_pii", "q_quality", "q_resample", "q_substring", "q_url_filter"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"webloom.llm.{name}")


load()
query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
