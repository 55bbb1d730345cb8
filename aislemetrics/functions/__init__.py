"""Column expressions, aggregates and running totals used by the operators."""
