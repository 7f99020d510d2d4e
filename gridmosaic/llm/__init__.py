"""Operators for preparing training text: quality, mixing, deduplication, extraction, formatting and filters."""
