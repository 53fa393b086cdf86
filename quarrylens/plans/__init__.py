"""Named queries; importing the package registers all of them."""

from quarrylens.plans import answer_queries, evaluation_queries, retrieval_queries, telemetry_queries, text_queries  # noqa: F401
from quarrylens.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
