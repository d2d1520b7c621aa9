"""Every query of the library by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.sources.fixtures import duck

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "temporal_rollup"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with DuckDB SQL over the fixture views where SQL can express it."""

    def enter(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = duck(oracle)
        return fn

    return enter


from trackloom.plans import audit, bank, detection, intervals, masks, more, queues, sequences  # noqa: E402, F401
