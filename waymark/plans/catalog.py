"""Imports every query module, so that the registry is complete."""

from waymark.plans import q_filters, q_joins, q_nulls, q_polygons, q_presets, q_process, q_projections, q_results, q_sources, q_stream  # noqa: F401
from waymark.plans.registry import QUERIES, SQL  # noqa: F401
