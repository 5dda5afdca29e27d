"""Spark-first engine for pair-spread research on time-series bars."""
