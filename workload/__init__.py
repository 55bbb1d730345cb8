"""Registered queries over the benchmark tables."""

from workload.registry import QUERIES  # noqa: F401

from workload import (  # noqa: E402
    catalog,
    competitive,
    network,
    price_gap,
    pricing,
    primitives,
    quality,
    sales,
    sketches,
    stats,
    streaming,
    tables,
    timeseries,
)
