"""Incremental forms of resumed runs."""
