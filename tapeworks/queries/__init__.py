"""Registered queries over the given tables, each beside its SQL counterpart."""
from __future__ import annotations

from importlib import import_module

from tapeworks.session import tune

QUERIES: dict = {}
ORACLES: dict = {}
HOME: dict = {}
MODULES = ["bars", "indicators", "rolling", "anomaly", "volatility", "risk", "crossasset", "orderbook",
           "orderflow", "patterns", "sentiment", "quality", "drift", "models", "evaluation", "states", "streams", "keyed", "ranking", "extensions", "documents"]


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        def run(spark, sf_dir, _fn=fn):
            return _fn(tune(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        HOME[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def load_all(only=None):
    for m in MODULES:
        if only and m not in only:
            continue
        import_module(f"tapeworks.queries.{m}")
    return QUERIES, ORACLES
