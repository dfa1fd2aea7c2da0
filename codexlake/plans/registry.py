"""All queries of the core and the SQL they are held against."""

from __future__ import annotations

from codexlake.plans import corpus, evaluation, layout, merges, nested_pages, operations, page_history, pages, preparation, records  # noqa: F401
from codexlake.plans.catalog import ORACLES, QUERIES


__all__ = ["ORACLES", "QUERIES"]
