"""Append-only time-series tables with coverage metadata, queried through Spark."""
