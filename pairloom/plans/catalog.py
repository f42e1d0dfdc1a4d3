"""All queries and their SQL."""

from __future__ import annotations

from pairloom.plans import catalog_claims, catalog_feed, catalog_linking, catalog_matching, catalog_metrics, catalog_profiles, catalog_sources, catalog_text  # noqa: F401  (each module registers its queries)
from pairloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
