"""One registered query per operator, with the DuckDB SQL it is compared with."""

from queries.base import ORACLES, QUERIES
from queries import classifiers, report_queries, scalars, source_queries, store_queries

__all__ = ["ORACLES", "QUERIES", "classifiers", "report_queries", "scalars", "source_queries", "store_queries"]
