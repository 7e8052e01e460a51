"""A dictionary of queries and one of oracle SQL, filled by a decorator."""

from __future__ import annotations


def registry():
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def add(f):
            queries[name] = f
            if oracle is not None:
                sql[name] = oracle
            return f

        return add

    return queries, sql, query
