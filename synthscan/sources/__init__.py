"""Readers, sinks, and the caches of generated texts."""

from .readers import load, load_all
from .sinks import dataset_key, output_dir, scores_path

__all__ = ["dataset_key", "load", "load_all", "output_dir", "scores_path"]
