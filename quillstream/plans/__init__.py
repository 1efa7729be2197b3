"""Registered queries of the text and event operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from . import chunks, companions, exchange, injection, ledger, memory, pairs, parse, reporting, salience, signals, streams, upkeep

MODULES: list[ModuleType] = [chunks, pairs, salience, signals, injection, ledger, companions, memory, upkeep, parse, exchange, reporting, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every function ``q_<name>`` of the modules, by name."""
    return {name[2:]: f for m in MODULES for name, f in vars(m).items() if name.startswith("q_") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracles().items()}
