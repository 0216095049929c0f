"""All registered queries of the change-log engine, and their SQL."""

from tidemark.plans import arms, layout  # noqa: F401  they register their queries
from tidemark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
