"""Registered queries: operator runs on the driver tables, with oracle SQL."""

from gridmosaic.catalog.registry import ORACLES, QUERIES  # noqa: F401
from gridmosaic.catalog import (  # noqa: F401
    cells,
    entities,
    links,
    prompts,
    questions,
    similarity,
    sources,
    scoring,
)
