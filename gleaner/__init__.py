"""Gleaner: hybrid retrieval and text-corpus processing as Spark DataFrame plans."""

__version__ = "0.1.0"
