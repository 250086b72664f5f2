"""Imports every query module once and exposes the registry."""

from . import (  # noqa: F401
    analysis_queries,
    bench_queries,
    build_queries,
    decide_queries,
    flow_queries,
    lint_queries,
    metadata_queries,
    quality_queries,
    raster_queries,
    responsive_queries,
    source_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
