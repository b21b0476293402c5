"""Registered queries: each shapes the given tables and runs operators on them."""

import importlib

MODULES = ["links", "index", "index_store", "text", "rules", "findings", "diff", "traffic", "tech"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"webloom.plans.{name}")
