"""All registered queries and their SQL."""

from planforge.queries import models, rollups, tables  # noqa: F401
from planforge.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
