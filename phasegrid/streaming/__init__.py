"""Incremental processing of newly arriving observations."""
