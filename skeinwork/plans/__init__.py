"""Queries over the given tables."""

import importlib
import pkgutil


def load_all():
    """Import every module that registers queries and return the catalog."""
    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{mod.name}")
    return importlib.import_module(f"{__name__}.catalog")
