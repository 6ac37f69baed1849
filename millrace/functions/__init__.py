"""The dialect's functions as builders of Spark columns.

``REGISTRY`` maps each dialect name to its builder. String arguments name columns, as in PySpark; parameters such
as patterns, units and counts are plain Python values. Builders compose built-in expressions, so they stay in
Catalyst and whole-stage code; the few that can't are Arrow-batched pandas UDFs.
"""

from . import ai, aggregates, conditional, context, conversion, crypto, dates, files, geo, numbers, semistructured, strings, vectors
from .core import REGISTRY

__all__ = [
    "REGISTRY", "ai", "aggregates", "conditional", "context", "conversion", "crypto", "dates", "files", "geo", "numbers", "semistructured", "strings", "vectors",
]


def call(name: str, *args, **kwargs):
    """A dialect function by its name, in any case."""
    return REGISTRY[name.upper()](*args, **kwargs)
