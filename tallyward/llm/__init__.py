"""Operators a training-data pipeline needs: one module per operator, each with
``QUERIES`` (what the driver runs) beside the general interface."""

from importlib import import_module

from .common import tidy

_MODULES = ("decontaminate", "tokencount", "toxicity", "quality", "vectors", "chat", "simhash", "sharding", "mixing", "htmltext")


def queries():
    out = {}
    for name in _MODULES:
        out.update({key: tidy(query) for key, query in import_module(f"{__name__}.{name}").QUERIES.items()})
    return out


def oracle_sql():
    out = {}
    for name in _MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {}))
    return out
