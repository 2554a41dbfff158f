"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import DAY, LIMIT, WINDOW_MS


def limited(events: DataFrame, key: str, ts_ms: str, limit: int = LIMIT, window_ms: int = WINDOW_MS, keep_ms: int = DAY * 1000) -> DataFrame:
    """Stream form of the rate limit. State of a key: the times of its accepted events in the window, ``limit`` at most; it is
    kept for ``keep_ms`` after the key's last event, for events that come late."""
    names = [key, ts_ms]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(ts_ms, kind="stable")
        out = []
        for t in rows[ts_ms]:
            recent = [x for x in recent if x > t - window_ms]
            out.append(len(recent) < limit)
            if out[-1]:
                recent.append(int(t))
        state.update((recent,))
        state.setTimeoutDuration(max(window_ms, keep_ms))
        yield rows[names].assign(accepted=out)

    types = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {ts_ms} {types[ts_ms]}, accepted boolean", "recent array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, *by: str, length: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts behind a watermark (an addition of this engine)."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(window.alias("window"), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count("*").alias("n"))


def dismissals(events: DataFrame, key: str, ts: str, ttl: str = "24 hours") -> DataFrame:
    """Stream form of dismissals: (key, dismissed_at, expires_at) whenever a key is dismissed anew; a key's state goes when it
    expires by the watermark, which the stream must have on ``ts``."""
    from pyspark.sql import Row

    seconds = int(pd.Timedelta(ttl).total_seconds())

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = max(part[ts].max() for part in parts)
        if state.exists:
            newest = max(newest, pd.Timestamp(state.get[0], unit="us"))
        known = state.get[0] if state.exists else None
        at = int(newest.value // 1000)
        state.update(Row(at))
        expires = newest + pd.Timedelta(seconds=seconds)
        if expires.value // 1_000_000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(expires.value // 1_000_000))
        if at != known:
            yield pd.DataFrame({key: [k[0]], "dismissed_at": [newest], "expires_at": [expires]})

    types = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, dismissed_at timestamp, expires_at timestamp", "at long", "append", GroupStateTimeout.EventTimeTimeout)


def accepted_events(raw: DataFrame, path: str, checkpoint: str, *, json_col: str = "json", state_path: str | None = None, once: bool = False):
    """Validating sink: of every micro-batch the valid events go to ``path/events`` as JSON with their facet, the others to
    ``path/rejected`` with their reason. The settings at ``state_path`` are read anew with each batch: while ``opt_in`` is not
    ``true`` there, nothing is written (without a path there are no settings to obey)."""
    from ..operators import events as E
    from ..operators import state as S

    def each(batch: DataFrame, number: int) -> None:
        if state_path is not None:
            allowed = S.read_state(batch.sparkSession, state_path, ("opt_in",)).first()["value"]
            if allowed != "true":
                return
        good, bad = E.accept(batch, F.unix_timestamp(F.current_timestamp()), json_col)
        good.write.mode("overwrite").json(f"{path}/events/batch={number}")  # a batch that runs again replaces itself
        bad.select(json_col, "reason").write.mode("overwrite").json(f"{path}/rejected/batch={number}")

    writer = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()


def write_events(events: DataFrame, path: str, checkpoint: str, every: str = "5 minutes", once: bool = False):
    """Append events as Parquet, a micro-batch each five minutes, or all there is at once."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
