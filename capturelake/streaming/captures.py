"""Streams of captures: first-seen rows, windowed counts, and version chains in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_captures(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(captures: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Captures whose key was not seen within the delay; state older than the watermark is dropped."""
    return captures.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(captures: DataFrame, time: str, window: str = "1 day", delay: str = "1 hour", key: str = "domain") -> DataFrame:
    """(window_start, key, captures) per tumbling window; late rows within the delay still count."""
    counts = captures.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("captures"))
    return counts.select(F.col("window.start").alias("window_start"), key, "captures")


def version_stream(captures: DataFrame, time: str | None = None, forget: str = "365 days") -> DataFrame:
    """Version rows of a stream with url, timestamp and content_hash.

    State is the latest (timestamp, hash) of each url: a capture is compared with the latest one that arrived
    before it, as in ``version_chain_by_arrival``. Rows of one batch and url are taken in order of timestamp. With
    ``time``, an event time, a url is forgotten when none of its captures came for ``forget`` of the watermark; its next one is new.
    """
    schema = "url string, timestamp string, content_hash string, prev_hash string, change string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latest = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames))
        newest = rows["_time"].max() if time else None
        rows = rows.dropna(subset=["content_hash"]).sort_values(["timestamp", "content_hash"], kind="stable")
        out = []
        for t, h in zip(rows["timestamp"], rows["content_hash"]):
            prev = latest[1] if latest else None
            out.append((key[0], t, h, prev, "new" if prev is None else "unchanged" if prev == h else "content_update"))
            if latest is None or t >= latest[0]:
                latest = (t, h)
        if latest:
            state.update(latest)
            if time:
                seen = 0 if pd.isna(newest) else int(pd.Timestamp(newest).timestamp() * 1000)
                state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs(), 0) + int(pd.Timedelta(forget).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["url", "timestamp", "content_hash", "prev_hash", "change"])

    if time:
        captures = captures.withWatermark(time, forget)
    rows = captures.select("url", "timestamp", "content_hash", *([F.col(time).alias("_time")] if time else []))
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return rows.groupBy("url").applyInPandasWithState(step, schema, "timestamp string, content_hash string", "append", timeout)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there into Parquet files and stop; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
