"""The registered queries and, where SQL expresses one, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: What the query that is being declared has written already.
_WRITTEN: ContextVar[dict | None] = ContextVar("written", default=None)


def once(key: tuple, build: Callable):
    """``build()``, called once for each key within a registered query and those it calls; nothing is kept from one query to the next."""
    written = _WRITTEN.get()
    if written is None:
        return build()
    if key not in written:
        written[key] = build()
    return written[key]


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under ``name``."""

    def add(f: Callable) -> Callable:
        @wraps(f)
        def run(spark, sf_dir):
            if _WRITTEN.get() is not None:  # called by another query, whose tables it shares
                return f(spark, sf_dir)
            token = _WRITTEN.set({})
            try:
                return f(spark, sf_dir)
            finally:
                _WRITTEN.reset(token)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
