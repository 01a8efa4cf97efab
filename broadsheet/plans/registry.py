"""All registered queries of the news jobs."""

from __future__ import annotations

from . import audits, collection, dashboard, graphs, maintained, report_queries, streams, texts
from .prelude import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "audits", "collection", "dashboard", "graphs", "maintained", "report_queries", "streams", "texts"]
