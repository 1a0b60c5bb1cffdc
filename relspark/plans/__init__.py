"""Registered queries over the driver's tables, one module for each operator family."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
