"""Reusable distributed plan shapes shared by the operators."""
from tapeworks.plans.panel import Panel, number_rows, on_chunks, running, join_on  # noqa: F401
from tapeworks.plans.orderstats import (  # noqa: F401
    average_ranks, cumulative_counts, median_mad, quantiles,
)
