"""Queries that run as streams over the events table, and their batch results in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.session import shared_dir, table
from civicspark.streaming import activity as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(s: SparkSession, d: str) -> DataFrame:
    return A.parquet_stream(s, d, table(s, d, "events").schema, "events.parquet")


@query("SELECT event_id, user_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type <> 'error'")
def stream_events_batch_equiv(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).where("event_type <> 'error'")
    return A.drained(e.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(s: SparkSession, d: str) -> DataFrame:
    w = A.window_counts(A.event_time(_events(s, d), "ts"), "ts", ["event_type"], "1 hour")
    return A.drained(w, "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (o) HOUR AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(o) GROUP BY ALL""")
def sliding_counts(s: SparkSession, d: str) -> DataFrame:
    w = A.window_counts(A.event_time(_events(s, d), "ts"), "ts", ["event_type"], "2 hours", "1 hour")
    return A.drained(w, "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
    WITH b AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM b)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM i GROUP BY user_id, g""")
def session_windows(s: SparkSession, d: str) -> DataFrame:
    w = A.session_counts(A.event_time(_events(s, d), "ts"), "ts", ["user_id"], "30 minutes")
    out = A.drained(w, "complete")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


def _in_two_arrivals(s: SparkSession, parts: list[DataFrame], plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """plan over a folder whose files come in two arrivals, each drained by a run of its own that goes on from the last one's checkpoint."""
    base = f"{shared_dir(s)}/arrivals-{uuid.uuid4().hex}"
    out = None
    for p in parts:
        p.write.mode("append").parquet(f"{base}/in")
        out = A.drained(plan(A.parquet_stream(s, f"{base}/in", p.schema)), base=base)
    return out


@query("SELECT DISTINCT user_id, event_type FROM events")
def late_dedup(s: SparkSession, d: str) -> DataFrame:
    """Each (user, type) once, though all events come twice: those of the second arrival find theirs in the state."""
    e = table(s, d, "events").select("user_id", "event_type", "ts")
    return _in_two_arrivals(s, [e, e], lambda x: A.once(A.event_time(x, "ts", "400 days"), ["user_id", "event_type"])).select("user_id", "event_type")


@query("""
    WITH e AS (SELECT ts, event_id % 3 = 0 AS late FROM events), m AS (SELECT max(ts) FILTER (NOT late) - INTERVAL 10 MINUTE AS w1, max(ts) - INTERVAL 10 MINUTE AS w2 FROM e), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, late FROM e)
    SELECT window_start, count(*) AS n FROM w, m WHERE (NOT late OR window_start + INTERVAL 1 HOUR > date_trunc('millisecond', w1)) AND window_start + INTERVAL 1 HOUR <= date_trunc('millisecond', w2) GROUP BY 1""")
def late_rows(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts as they are finished: a third of the events arrives after the others, and what falls into windows that the watermark has closed is dropped."""
    e = table(s, d, "events").select("event_id", "ts")
    out = _in_two_arrivals(s, [e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")], lambda x: A.window_counts(A.event_time(x, "ts"), "ts", [], "1 hour"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
    WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s, max(ts) AS since FROM events GROUP BY 1)
    SELECT user_id, since FROM l WHERE s = 'error' AND since < (SELECT max(ts) FROM events) - INTERVAL 90 MINUTE""")
def stale_processing_reset(s: SparkSession, d: str) -> DataFrame:
    """Users whose latest event is an error of more than 90 minutes before the end (errors stand for work in progress)."""
    e = table(s, d, "events").select("user_id", "ts", F.when(F.col("event_type") == "error", "processing").otherwise("complete").alias("status"))
    end = e.agg(F.max("ts")).first()[0]
    return A.stale(e, "user_id", "ts", "status", "90 minutes", F.lit(end))
