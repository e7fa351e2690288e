"""Typed readers and durable results."""
