"""Bindings of the operators to the test tables, and the registered queries with their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from quillon.plans import registry


def registered():
    """The registry, after every module of queries has been imported."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry
