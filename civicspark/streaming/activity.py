"""Structured Streaming over event files: windows with watermarks, deduplication, normalised sinks and stale-work timers.

Late data: rows older than the watermark (10 minutes by default) are dropped by windowed aggregates. Cursors are the
query's checkpoint, so a restart neither loses nor repeats rows in a Parquet sink.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from civicspark.session import shared_dir

WATERMARK = "10 minutes"


def parquet_stream(spark: SparkSession, folder: str, schema: StructType, name_glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name_glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def json_lines_stream(spark: SparkSession, folder: str, name_glob: str = "*.jsonl") -> DataFrame:
    """Lines of files as they arrive; a line that is still being written belongs to a file that is renamed into place when done."""
    return spark.readStream.option("pathGlobFilter", name_glob).text(folder)


def event_time(df: DataFrame, ts: str, watermark: str = WATERMARK) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def window_counts(df: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None) -> DataFrame:
    """(window_start, keys, n): tumbling, or sliding if `slide` is given; for batches and streams."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(df: DataFrame, ts: str, keys: list[str], gap: str) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> object:
    """Start an exactly-once Parquet sink: what there is, or, with `every`, continuously."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> object:
    """Start a work queue: `work` gets each batch of new rows (and its number, for idempotent writes)."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run the stream over what there is and return its result as a table in the shared folder.

    append: rows as finished (windows after their watermark); complete: the whole aggregate after the last batch. `base` names
    the run's folder: a second run with it goes on from where the first ended, with its state and watermark.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        to_parquet(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    else:
        write = lambda b, _: b.write.mode("overwrite").parquet(f"{base}/out")
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stale(statuses: DataFrame, key: str, ts: str, status: str, limit: str, now: Column) -> DataFrame:
    """Batch form: keys whose latest status is processing and older than `limit` before `now`."""
    last = statuses.groupBy(key).agg(F.max_by(F.struct(status, ts), ts).alias("r")).select(key, F.col(f"r.{status}").alias("status"), F.col(f"r.{ts}").alias("since"))
    return last.where((F.col("status") == "processing") & (F.col("since") < now - F.expr(f"interval {limit}"))).select(key, "since")


def stale_stream(statuses: DataFrame, key: str, ts: str, status: str, minutes: int = 90) -> DataFrame:
    """(key, since) of keys that stay in `processing` for `minutes` of event time; statuses has a watermark on ts.

    State per key is its latest status and time; a timer is set while it is processing and cleared by any other status.
    """
    kind = dict(statuses.dtypes)[key]
    src = statuses.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(status).alias("s"))

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "since": [pd.Timestamp(since, unit="us")]})
            return
        last, processing = state.get if state.exists else (-1, False)
        for b in batches:
            for t, s in zip(b["t"], b["s"], strict=True):
                us = int(pd.Timestamp(t).value // 1000)
                if us >= last:
                    last, processing = us, s == "processing"
        state.update((last, processing))
        if processing:
            due = last // 1000 + minutes * 60_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return src.groupBy("k").applyInPandasWithState(update, f"{key} {kind}, since timestamp", "last bigint, processing boolean", "append", GroupStateTimeout.EventTimeTimeout)
