"""All registered queries and their DuckDB oracles."""

from . import alignment_queries, join_queries, learning_queries, metric_queries, model_queries, placement_queries, report_queries, scalar_queries, series_queries, tracking_queries, window_queries  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
