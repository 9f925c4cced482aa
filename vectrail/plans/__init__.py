"""The registered queries with their SQL, and the tables derived for them."""

from vectrail.plans import flows, queries, search, tracks

__all__ = ["flows", "queries", "search", "tracks"]
