"""Named queries over the test tables, each with its SQL where SQL can express it."""

from affinade.catalog import findings, models, reports, sweeps, tables  # noqa: F401  they register their queries
from affinade.catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
