"""Trace-table sources, views, sinks and the projections of the driver tables."""
