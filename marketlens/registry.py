"""All queries of the market engine, by name, each with its twin in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries: each has QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("plans.stats", "plans.history", "plans.joins", "plans.windows", "plans.validity", "plans.features", "plans.planning", "plans.streams", "plans.model", "plans.delivery")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"marketlens.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"marketlens.{m}").ORACLES.items()}
