"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pricelore.sources.views import VIEWS_SQL, Domain


class Registry:
    """Queries by name, each a function of a Domain, and their SQL after the views."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
            if sql is not None:
                self.oracles[f.__name__] = VIEWS_SQL + sql
            return f

        return add
