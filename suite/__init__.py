"""Registered queries over the benchmark tables, each with its SQL oracle.

The benchmark tables stand in for strain, medium and genome data; every query
reads whole tables and calls the library operators users call.
"""

from suite.base import REGISTRY
from suite import (  # noqa: F401  (importing registers the queries)
    catalog,
    documents,
    embeddings,
    encoders,
    evaluation,
    files,
    media,
    models,
    rules,
    sequences,
    strains,
    streams,
    study,
    tables,
)

__all__ = ["REGISTRY"]
