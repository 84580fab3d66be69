"""An extension: the re-crawl as a stream. Batches find a changed hash by comparing with the last crawl; here the state lives with the stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def fresh_captures(crawl: DataFrame, watermark: str = "168 hours") -> DataFrame:
    """Captures (url, content_hash, seen_at) once per address and content within the watermark."""
    return crawl.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["url", "content_hash"])


def content_changes(crawl: DataFrame, forget_after_ms: int = 400 * 86_400_000) -> DataFrame:
    """(url, previous_hash, content_hash, seen_at) whenever an address shows other content than before; the first sight is no change.

    An address that is not seen for ``forget_after_ms`` of processing time is forgotten, so the state holds what is still crawled.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = []
        for f in frames:
            for h, at in sorted(zip(f["content_hash"], f["seen_at"]), key=lambda r: (r[1], r[0])):
                if last is not None and h != last:
                    rows.append((key[0], last, h, at))
                last = h
        state.update((last,))
        state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(rows, columns=["url", "previous_hash", "content_hash", "seen_at"])

    return crawl.groupBy("url").applyInPandasWithState(step, "url string, previous_hash string, content_hash string, seen_at timestamp", "content_hash string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def hourly_counts(crawl: DataFrame, late: str = "2 hours") -> DataFrame:
    return crawl.withWatermark("seen_at", late).groupBy(F.window("seen_at", "1 hour").alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "status", "n")
