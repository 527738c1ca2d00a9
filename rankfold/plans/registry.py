"""Where queries register themselves with their SQL twins."""

from __future__ import annotations

import functools

from ..shipping import ship
from ..sources.views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its name; sql may name the views of sources.views."""

    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add
