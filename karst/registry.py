"""All queries of the core, by name, with their SQL where SQL can state them.

`QUERIES` and `ORACLE` load the modules whose queries register themselves when they are first asked
for, so any of these modules can be imported by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}
FLAGSHIP = "hybrid_graph_search"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL under a name."""

    def put(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql:
            _oracle[name] = sql
        return f

    return put


def load() -> None:
    """Import the modules whose queries register themselves."""
    from karst.plans import analytics, answers, assistant, details, documents, files, graphs, layout, search, streams  # noqa: F401


def __getattr__(name: str) -> dict:
    if name not in ("QUERIES", "ORACLE"):
        raise AttributeError(name)
    load()
    return _queries if name == "QUERIES" else _oracle
