"""Incremental processing of new acquisitions."""
