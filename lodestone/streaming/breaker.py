"""A circuit breaker as a fold over each service's calls in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALLS = "service string, call_id long, ts timestamp, ok boolean, state string, passed boolean"


def step(state: tuple[str, int, float], ok: bool, now: float, threshold: int, base: float, most: float) -> tuple[tuple[str, int, float], bool]:
    """State (name, failures in a row, open until) and whether the call was let through.

    Closed opens after ``threshold`` failures; open lets one call through after base * 2**n seconds, at most ``most``.
    """
    name, failures, until = state
    if name == "open":
        if now < until:
            return state, False
        name = "half_open"
    if ok:
        return ("closed", 0, 0.0), True
    failures += 1
    if name == "half_open" or failures >= threshold:
        return ("open", failures, now + min(most, base * 2 ** max(0, failures - threshold))), True
    return ("closed", failures, 0.0), True


def run_breaker(calls: DataFrame, threshold: int = 3, base: float = 5.0, most: float = 60.0) -> DataFrame:
    """``calls(service, call_id, ts, ok)`` with the state after each and whether it was let through."""
    rows = calls.select("service", F.col("call_id").cast("long").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), "ok")
    ordered = rows.repartition("service").sortWithinPartitions("service", "ts", "call_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, state = None, ("closed", 0, 0.0)
        for batch in batches:
            names, passed = [], []
            for who, now, ok in zip(batch["service"], batch["ts"].map(pd.Timestamp.timestamp), batch["ok"], strict=True):
                if who != service:
                    service, state = who, ("closed", 0, 0.0)
                state, let = step(state, bool(ok), now, threshold, base, most)
                names.append(state[0])
                passed.append(let)
            yield batch.assign(state=names, passed=passed)

    from lodestone.session import ship

    ship(calls.sparkSession)
    return ordered.mapInPandas(run, CALLS)
