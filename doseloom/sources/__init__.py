"""Typed readers and partitioned writers."""
