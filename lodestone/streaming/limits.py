"""Fixed-window rate limits: a batch fold and its streaming twin share one step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "user_id long, event_id long, ts timestamp, count long, allowed boolean"


def step(start: float | None, count: int, now: float, window: float, limit: int, count_denied: bool) -> tuple[float, int, bool]:
    """Window start, count and verdict after a hit. The first hit after a window's end starts the next."""
    if start is None or now >= start + window:
        return now, 1, limit >= 1
    if count >= limit:
        return start, count + 1 if count_denied else count, False
    return start, count + 1, True


def decide(events: DataFrame, seconds: int, limit: int, count_denied: bool = True) -> DataFrame:
    """Every hit's count and verdict, by a fold over each user's hits in order of time.

    The fold keeps one small state a user; hits come sorted, in batches, so a user with very many is not gathered.
    """
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, count = None, None, 0
        for batch in batches:
            counts, verdicts = [], []
            for who, now in zip(batch["user_id"], batch["ts"].astype("int64") / 1e9 if str(batch["ts"].dtype).endswith("[ns]") else batch["ts"].map(pd.Timestamp.timestamp), strict=True):
                if who != user:
                    user, start, count = who, None, 0
                start, count, ok = step(start, count, now, seconds, limit, count_denied)
                counts.append(count)
                verdicts.append(ok)
            yield batch.assign(count=counts, allowed=verdicts)

    from lodestone.session import ship

    ship(events.sparkSession)
    return ordered.mapInPandas(run, DECISION)


def decide_stream(events: DataFrame, seconds: int, limit: int, count_denied: bool = True, late: str = "1 hour") -> DataFrame:
    """The same verdicts over a stream. State is one window a user, dropped once the watermark has passed its end.

    Hits of one trigger are put in order of time; a hit older than those decided
    before counts in the window that is open. Of a user's hits only id and time
    of one trigger are held.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        hits = sorted((ts.timestamp(), event, ts) for b in batches for ts, event in zip(b["ts"], b["event_id"], strict=True))
        rows = []
        for now, event, ts in hits:
            start, count, ok = step(start, count, now, seconds, limit, count_denied)
            rows.append((key[0], event, ts, count, ok))
        state.update((start, count))
        state.setTimeoutTimestamp(max(int((start + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "ts", "count", "allowed"])

    from lodestone.session import ship

    ship(events.sparkSession)
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(run, DECISION, "start double, count long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type; over a stream, with a watermark for late rows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
