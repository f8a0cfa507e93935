"""The queries of the library and their SQL, by name."""

import lumenfold.index_queries  # noqa: F401  registers its queries
from lumenfold.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
