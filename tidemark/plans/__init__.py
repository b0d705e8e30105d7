"""One query for each operator; importing this package registers all of them."""

from tidemark.plans import breadth, catalogue, chain, learning, relational, valuing  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
