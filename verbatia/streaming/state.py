"""Keyed state over event streams: request limiting, call tracking, cooldown; in batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def demand(events: DataFrame, seconds: int = 60, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Each event with the number of the key's events in the window that ends with it, accepted or not."""
    order = F.col(ts).cast("timestamp").cast("double")
    return events.withColumn("n_window", F.count("*").over(W.partitionBy(key).orderBy(order).rangeBetween(-seconds, 0)))


def admit(times: list[float], recent: deque, limit: int, seconds: float) -> list[bool]:
    """Decisions on events in order: refused events are not counted; an accepted one counts until it is older than the window."""
    out = []
    for t in times:
        while recent and t - recent[0] > seconds:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def fold_sorted(rows: DataFrame, step, start, result: str) -> DataFrame:
    """Rows of (key, event_id, t, ...) folded by key in order of t and event_id, to rows of (key, event_id, result).

    ``step(state, t, ...)`` gives the result of a row and changes the state, which ``start()`` makes for each key.
    Sorted batches are read one after the other, so that only the state of a key is held, not its rows.
    """
    key, event_id = rows.columns[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for k, t, *more in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns) if i != 1)):
                if state is None or k != now:
                    now, state = k, start()
                out.append(step(state, float("nan") if t is None else t, *more))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names)

    names = [key, event_id, result]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, event_id)]
    return rows.repartition(key).sortWithinPartitions(key, F.asc_nulls_last("t"), event_id).mapInArrow(run, f"{', '.join(kinds)}, `{result}` boolean")


def rate_limit(events: DataFrame, limit: int = 10, seconds: int = 60, key: str = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(key, event_id, accepted): the sliding-window limiter over each key's events in order.

    A key's decisions depend on each other, so they are one fold over its ordered times.
    """
    rows = events.select(key, event_id, F.col(ts).cast("timestamp").cast("double").alias("t"))
    return fold_sorted(rows, lambda recent, t: admit([t], recent, limit, seconds)[0], deque, "accepted")


def rate_limit_stream(events: DataFrame, limit: int = 10, seconds: int = 60, key: str = "user_id", ts: str = "ts", event_id: str = "event_id", late: str = "2 minutes") -> DataFrame:
    """The limiter over a stream; the state of a key is its accepted times within the window, at most ``limit``, and ends with the window."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(key, event_id, ts, F.col(ts).cast("double").alias("t"))

    def fold(keys, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(pdfs).sort_values(["t", event_id])
        accepted = admit(pdf.t.tolist(), recent, limit, seconds)
        state.update((list(recent),))
        wake = int((pdf.t.max() + seconds) * 1000)
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: keys[0], event_id: pdf[event_id], "accepted": accepted})

    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} long, {event_id} long, accepted boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def demand_stream(events: DataFrame, seconds: int = 60, key: str = "user_id", ts: str = "ts", late: str = "2 minutes") -> DataFrame:
    """Events of each key by tumbling window, in event time."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(key, F.window(ts, f"{seconds} seconds")).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def track_calls(events: DataFrame, outcome: str, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events with the key's running counts of calls, successes and failures, and the last failure's number."""
    so_far = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ok = F.expr(outcome).cast("int")
    return events.select("*", F.count("*").over(so_far).alias("calls"), F.sum(ok).over(so_far).alias("ok"), F.sum(1 - ok).over(so_far).alias("failed"), F.last(F.when(ok == 0, F.col("event_id")), ignorenulls=True).over(so_far).alias("last_failure"))


def cooldown(events: DataFrame, outcome: str, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """(key, event_id, skipped): after a failure of a call that was made, calls are skipped for a time; skipped calls have no outcome."""
    rows = events.select(key, "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), F.expr(outcome).alias("ok"))

    def step(until: list[float], t: float, ok: bool | None) -> bool:
        skipped = t < until[0]
        if not skipped:
            until[0] = float("-inf") if ok else t + seconds
        return skipped

    return fold_sorted(rows, step, lambda: [float("-inf")], "skipped")


def freshness(now, fetched_at, last_failure, ttl: int = 24 * 3600, stale: int = 7 * 24 * 3600, backoff: int = 60):
    """What to do about a cached source, as a column: use, refresh, use_stale (a failure was recent) or unavailable."""
    age = now - fetched_at
    resting = last_failure.isNotNull() & (now - last_failure < backoff)
    return F.when(age <= ttl, "use").when(~resting, "refresh").when(age <= stale, "use_stale").otherwise("unavailable")
