"""Debouncing of a feed without keys, batch by batch, against a plain walk over all events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from assetloom.session import fresh_dir
from assetloom.streaming import changes as W

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)


def frame(spark, seconds):
    return spark.createDataFrame([(ZERO + timedelta(seconds=s),) for s in seconds], "event_time TIMESTAMP")


def plain(seconds, gap):
    out = []
    for s in sorted(seconds):
        if out and s - out[-1][1] <= gap:
            out[-1] = (out[-1][0], s, out[-1][2] + 1)
        else:
            out.append((s, s, 1))
    return out


def got(feed):
    at = lambda t: (t.replace(tzinfo=timezone.utc) - ZERO).total_seconds()
    return sorted((at(r.first_change), at(r.last_change), r.changes) for r in feed.bursts().collect())


def test_batches_out_of_order_and_replayed(spark, monkeypatch):
    monkeypatch.setattr(W, "CHUNK_BUCKETS", 4)  # bursts cross chunks
    pick = random.Random(2)
    gap, delay = 10, 60
    events, now = [], 0.0
    for _ in range(500):
        now += pick.choice([1, 2, 5, 10, 10, 11, 30])
        events.append(now)
    late = sorted(events, key=lambda s: s + pick.random() * delay * 0.9)  # never later than the watermark allows
    feed = W.BurstFeed(spark, fresh_dir(spark, "bursts"), gap, delay)
    for epoch, start in enumerate(range(0, 500, 90)):
        feed(frame(spark, late[start:start + 90]), epoch)
    feed(frame(spark, late[450:]), 5)  # a replay
    want = [b for b in plain(events, gap) if b[1] + gap <= max(events) - delay]
    assert got(feed) == want and len(want) > 20


def test_a_burst_that_goes_on_keeps_little_state(spark):
    feed = W.BurstFeed(spark, fresh_dir(spark, "bursts"), 10, 20)
    for epoch in range(4):
        feed(frame(spark, [epoch * 500 + k for k in range(500)]), epoch)
        state = feed._table("open", feed.SPANS).where(f"epoch = {epoch}").collect()
        assert sum(r._n for r in state) == (epoch + 1) * 500 and len(state) <= 6
    assert got(feed) == []
    feed(frame(spark, [9000]), 4)
    feed(frame(spark, []), 5)
    assert got(feed) == [(0.0, 1999.0, 2000)]


def test_empty_and_too_late(spark):
    feed = W.BurstFeed(spark, fresh_dir(spark, "bursts"), 10, 5)
    feed(frame(spark, []), 0)
    feed(frame(spark, [100, 200]), 1)
    feed(frame(spark, [104, 195, 300]), 2)  # 104 comes when its burst has closed
    assert got(feed) == [(100.0, 100.0, 1), (195.0, 200.0, 2)]
    with pytest.raises(ValueError, match="BurstFeed"):
        W.debounce_stream(frame(spark, [1]), "1 second", "1 second", [])
