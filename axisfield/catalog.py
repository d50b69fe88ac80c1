"""All queries of the library by name, without those of the training-data operators."""

from axisfield import boundary_queries, learned_queries, more_queries, objectives, planar_queries, shapes_queries  # noqa: F401 - these register their queries
from axisfield.queries import QUERIES, SQL, entry, oracle_sql, queries

__all__ = ["QUERIES", "SQL", "entry", "oracle_sql", "queries"]
