"""All registered queries."""

import importlib
import pkgutil

from skyfold.plans.registry import CHECKS, QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["CHECKS", "QUERIES"]
