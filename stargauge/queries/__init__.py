"""The query registry: every operator as a query over the warehouse tables, with its SQL."""

from stargauge.queries.registry import all_queries

__all__ = ["all_queries"]
