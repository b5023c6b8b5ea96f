"""Registered queries: one per operator, each with the SQL that must give the same rows."""

from ratergrid.plans import (agreement, alignment, ingestion, posts, profile, reports, responses,
                             sampling, streams)
from ratergrid.plans.registry import REGISTRY

__all__ = ["REGISTRY", "agreement", "alignment", "ingestion", "posts", "profile", "reports",
           "responses", "sampling", "streams"]
