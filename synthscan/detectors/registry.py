"""The catalogue of detectors."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)
_DETECTORS: dict[str, type[Detector]] = {}


class Detector(ABC):
    """Scores texts: score() takes (row_id, text, ...) and returns (row_id, score), lazily; null where undefined."""

    name: str
    #: The kind of model output that the score is made of, tokens or cross, where others may share it.
    needs: str | None = None

    def __init__(self, **options) -> None:
        self.options = options

    @abstractmethod
    def score(self, df: DataFrame) -> DataFrame: ...

    @classmethod
    def add_arguments(cls, parser) -> None:
        """Options of its own for the command line."""

    def teardown(self) -> None:
        """Let go of what it holds."""


def register(name: str):
    """Class decorator; registering a name again replaces it, with a warning."""

    def wrap(cls: type[Detector]) -> type[Detector]:
        if name in _DETECTORS:
            log.warning("Detector %r is registered again.", name)
        _DETECTORS[name] = cls
        cls.name = name
        return cls

    return wrap


def get_detector(name: str) -> type[Detector]:
    if name not in _DETECTORS:
        raise KeyError(f"Unknown detector {name!r}. Available: {', '.join(sorted(_DETECTORS))}")
    return _DETECTORS[name]


def list_detectors() -> list[str]:
    return sorted(_DETECTORS)


def all_detectors() -> dict[str, type[Detector]]:
    return dict(_DETECTORS)
