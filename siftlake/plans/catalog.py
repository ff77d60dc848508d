"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from siftlake.plans import (  # noqa: F401
    corpus_queries,
    finding_queries,
    report_queries,
    stream_queries,
    transcript_queries,
)
from siftlake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
