"""Queries of this subpackage, as the entry point registers them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules in problem order; each has QUERIES and may have ORACLE.
MODULES = (
    "sentences",
    "canonical",
    "batchdedup",
    "pii",
    "neighbors",
    "splitting",
    "leakage",
    "mixing",
    "spam",
)


#: Imported with the registry, so that one that cannot be imported shows where the registry is.
_LOADED = [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _LOADED:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _LOADED:
        out.update(getattr(m, "ORACLE", {}))
    return out
