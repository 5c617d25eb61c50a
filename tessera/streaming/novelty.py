"""Streaming forms: event counts by time window, and signatures that have not been seen before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) of each window; events later than ``late`` are dropped (streams only)."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def new_signatures(stream: DataFrame) -> DataFrame:
    """(sig, n) the first time that a signature comes in a stream of (sig); n counts it in that batch."""

    def first(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = sum(len(b) for b in batches)
        if not state.exists:
            state.update((True,))
            yield pd.DataFrame({"sig": [key[0]], "n": [n]})

    return stream.groupBy("sig").applyInPandasWithState(first, "sig string, n long", "seen boolean", "append", GroupStateTimeout.NoTimeout)
