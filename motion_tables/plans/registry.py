"""How a module of queries registers them."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        """Registers the decorated query, with its SQL if it has any."""

        def mark(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return mark
