"""All queries of the engine, by name, with the SQL that states the same result."""

from __future__ import annotations

from . import registry
from .plans import agents, aggregates, comparison, datasets, judging, retrieval, statistics, streams, text  # noqa: F401  they register their queries


def queries():
    return registry.QUERIES


def oracle_sql():
    return registry.SQL
