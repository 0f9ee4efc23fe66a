"""How a module of plans names its queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldloom.sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]


def greedy(source: str, keys: list[str], item: str, order: str, conflict: str) -> str:
    """SQL of a pass over the rows of each group in order, which keeps an item unless a kept one is in conflict with it:
    keys and the kept items as k. The condition compares a kept item y with the new one, x[1]."""
    fold = f"list_reduce(list([{item}] order by {order}), lambda acc, x: case when len(list_filter(acc, lambda y: {conflict})) > 0 then acc else list_concat(acc, x) end)"
    return f"select {', '.join(keys)}, unnest({fold}) as k from {source} group by {', '.join(keys)}"


class Plans:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, more: str = "") -> Callable[[Query], Query]:
        """Registers a query under its function's name; sql may name the views of fixtures, more adds CTEs."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = with_views(sql, more)
            return f

        return add

    def also(self, name: str, former: str) -> None:
        """The query under a former name too."""
        self.queries[former] = self.queries[name]
        if name in self.oracles:
            self.oracles[former] = self.oracles[name]
