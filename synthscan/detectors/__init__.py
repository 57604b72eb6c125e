"""Detectors, found and registered on import."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import Detector, all_detectors, get_detector, list_detectors, register

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["Detector", "all_detectors", "get_detector", "list_detectors", "register"]
