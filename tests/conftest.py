from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assetloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_px(spark):
    """Pixels from {asset: (w, h, fn(x, y) -> (r, g, b, a))}."""
    def make(images):
        rows = [(k, w, h, x, y, *fn(x, y)) for k, (w, h, fn) in images.items() for y in range(h) for x in range(w)]
        return spark.createDataFrame(rows, "asset_id BIGINT, w INT, h INT, x INT, y INT, r INT, g INT, b INT, a INT")
    return make
