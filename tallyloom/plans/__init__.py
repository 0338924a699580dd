"""Registered queries: every operator over the driver's tables, with its SQL counterpart."""

from tallyloom.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
