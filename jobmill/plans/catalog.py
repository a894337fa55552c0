"""All registered queries; importing the modules registers them."""

from jobmill.plans import columns, listing_queries, page_queries, snapshot_queries  # noqa: F401
from jobmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
