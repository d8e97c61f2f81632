"""Registered queries, one module per operator group."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module and return the registry."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
    from hirelens.plans import registry
    return registry
