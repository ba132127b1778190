"""Incremental form of the load job."""
