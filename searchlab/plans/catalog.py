"""All registered queries and their check SQL."""

from searchlab.plans import catalog_corpus, catalog_evaluation, catalog_search, catalog_sinks  # noqa: F401
from searchlab.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
