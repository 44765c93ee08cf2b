"""Incremental forms for growing folders of data."""
