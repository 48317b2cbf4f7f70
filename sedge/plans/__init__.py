"""Plans: operators put together over the tables, registered by name."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """The catalog with every plan of this package registered."""
    for found in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{found.name}")
    return importlib.import_module(f"{__name__}.catalog")
