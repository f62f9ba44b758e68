"""All registered queries and their SQL oracles, gathered from the catalog modules."""

from __future__ import annotations

import functools

from ..session import ship_package
from . import daily, files, metrics, models, products, scoring, text

_MODULES = [daily, products, scoring, metrics, text, files, models]


def _shipped(fn):
    """Wrap a query so the package reaches the Python workers before it runs."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def queries():
    out = {}
    for m in _MODULES:
        out.update({k: _shipped(v) for k, v in m.QUERIES.items()})
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.SQL)
    return out
