"""All registered queries; importing this package fills the registry."""

from pagelore.catalog.registry import QUERIES, Tables
from pagelore.catalog import (  # noqa: F401
    answers,
    corpus,
    metrics,
    retrieval,
    scoring,
    streams,
)

__all__ = ["QUERIES", "Tables"]
