"""Where a family of queries is kept."""

from __future__ import annotations

from chunkline.plans.fixtures import duck


class Family:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Registers a query, and its DuckDB SQL over the tables and fx_ views."""

        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = duck(sql)
            return f

        return add
