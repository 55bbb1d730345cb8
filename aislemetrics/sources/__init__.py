"""Readers, sinks and the retail views over the benchmark tables."""
