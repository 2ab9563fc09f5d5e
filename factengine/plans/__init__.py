"""Queries over the driver's tables, with the SQL that checks them."""

from . import rule_queries, scalar_queries  # noqa: F401, I001
from . import norm_queries  # noqa: F401
from . import ops_queries  # noqa: F401
from . import audit_queries  # noqa: F401
from . import whole_queries  # noqa: F401
from . import case_queries, document_queries, listing_queries, ordered_queries, reference_queries, release_queries, store_queries, stream_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
