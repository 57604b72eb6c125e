"""Models behind one interface: built-in n-gram models, tables of precomputed output, optional neural and API back ends."""

from .base import Provider, regenerator, reviser
from .ngram import NGramModel
from .table import TableProvider

__all__ = ["NGramModel", "Provider", "TableProvider", "regenerator", "reviser"]
