"""Radar-trace analytics on Spark: DataFrame operators for trace tables, position fixes and spectra."""
