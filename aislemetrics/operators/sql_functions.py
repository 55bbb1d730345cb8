"""The row-level classifiers as SQL functions of the session.

They are SQL text, made from the limits that the column forms use, so the optimizer inlines them into
the query that calls them: no Python, and filters and column pruning pass through.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .prepare import PRICE_SEGMENTS, SALES_LEVELS, STOCK_LEVELS

#: name: (argument, limits and names); NULL and values up to the first limit have no class
FUNCTIONS = {
    "price_segment": ("price", PRICE_SEGMENTS),
    "sales_class": ("amount", SALES_LEVELS),
    "stock_class": ("quantity", STOCK_LEVELS),
}


def _body(argument: str, levels: tuple) -> str:
    edges, names = levels
    steps = [f"when {argument} is null or {argument} <= {edges[0]} then null"]
    for upper, name in zip(edges[1:-1], names):
        steps.append(f"when {argument} <= {upper} then '{name}'")
    return f"case {' '.join(steps)} else '{names[-1]}' end"


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; names as in ``FUNCTIONS``."""
    for name, (argument, levels) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({argument} double) returns string return {_body(argument, levels)}")
    return list(FUNCTIONS)
