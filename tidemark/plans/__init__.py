"""The registered queries: every operator run over whole tables, each with the SQL that gives the same result."""

from tidemark.plans import (  # noqa: F401  (importing registers the queries)
    directory,
    graphs,
    ingest,
    profiles,
    quality,
    reads,
    streams,
    sync,
    versions,
    workflows,
)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
