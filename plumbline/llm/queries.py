"""Imports every query module of this subpackage."""

from __future__ import annotations

import importlib
import pkgutil

from plumbline import llm
from plumbline.llm.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(llm.__path__):
    if _module.name.endswith("_queries"):
        importlib.import_module(f"{llm.__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
