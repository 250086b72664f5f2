"""Explicit table schemas and the entry check shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

PIXELS = "asset_id BIGINT, w INT, h INT, x INT, y INT, r INT, g INT, b INT, a INT"
SCANLINES = ("asset_id BIGINT, w INT, h INT, y INT, r ARRAY<INT>, g ARRAY<INT>, b ARRAY<INT>, "
             "a ARRAY<INT>")
CANDIDATES = ("asset_id BIGINT, cand_idx INT, fmt STRING, disposition STRING, quality INT, "
              "bytes BIGINT, met_target BOOLEAN")
LADDER = "asset_id BIGINT, q INT, metric DOUBLE, bytes BIGINT"
TAGS = "asset_id BIGINT, ifd STRING, tag BIGINT, value STRING"
SEGMENTS = "seg_idx INT, kind STRING, offset BIGINT, length BIGINT"
CHANGES = "path STRING, event_time TIMESTAMP"
LOCK = "path STRING, source STRING, recipe STRING, key STRING, hash STRING, bytes BIGINT"
CACHE = "key STRING, ext STRING, payload BINARY, payload_len BIGINT, payload_hash STRING"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail early, naming what is missing, when ``df`` lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {df.columns}")
    return df
