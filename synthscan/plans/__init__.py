"""Whole runs: scoring with resumption, evaluation, the command line."""
