"""Imports every query module, which fills the catalogue."""

from tallyscope.plans import (  # noqa: F401
    cluster_queries,
    context_queries,
    feature_queries,
    label_queries,
    ledger_queries,
    model_queries,
)
from tallyscope.plans.catalogue import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
