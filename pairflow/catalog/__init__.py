"""Queries over the test tables, one per operator, each with its SQL counterpart.

The SQL is written from the meaning of the operator, not from the Spark code.
"""

from pairflow.catalog.registry import ORACLES, QUERIES
from pairflow.catalog import (  # noqa: F401  (each module registers its queries)
    aggregate_queries,
    fit_queries,
    io_queries,
    job_queries,
    join_queries,
    order_queries,
    report_queries,
    scalar_queries,
    select_queries,
    set_queries,
    vector_queries,
)

__all__ = ["ORACLES", "QUERIES"]
