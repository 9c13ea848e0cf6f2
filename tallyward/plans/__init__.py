"""Named queries over the driver's tables, each beside its SQL."""

from importlib import import_module

_MODULES = ("review", "formats")


def queries():
    out = {}
    for name in _MODULES:
        out.update(import_module(f"{__name__}.{name}").QUERIES)
    return out


def oracle_sql():
    out = {}
    for name in _MODULES:
        out.update(import_module(f"{__name__}.{name}").ORACLE)
    return out
