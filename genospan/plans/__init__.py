"""Interval views over the benchmark tables and the named queries built on them."""
