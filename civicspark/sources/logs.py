"""Activity logs: kernel-audit text, JSON lines of file events, terminal sessions, and their common event row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import text as X

#: What a terminal session is searched for.
SESSION_PATTERNS = {
    "models": r"\b((?:gpt|claude|llama|mistral|qwen|gemma)[-\w.:]*)",
    "paths": r"(/(?:home|opt|srv|var|etc|data)/[\w./\-]+)",
    "commands": r"(?m)^\$ (.+)$",
    "errors": r"(?im)^(.*\b(?:error|exception|traceback|failed)\b.*)$",
}


def parse_audit(lines: DataFrame, line: str = "value") -> DataFrame:
    """(serial, timestamp, event_type, file_path, command, exe, pid, uid, success, audit_key) per audit event.

    Lines of one event share a serial. Events of configuration changes alone are dropped; the path is that of a NORMAL or CREATE
    entry before any other. Lines without a serial or a time are left out.
    """
    v = F.col(line)
    get = lambda p: X.nonempty(F.regexp_extract(v, p, 1))
    f = lines.select(
        get(r"type=(\w+)").alias("type"), get(r"msg=audit\([\d.]+:(\d+)\)").alias("serial"), get(r"msg=audit\(([\d.]+):\d+\)").try_cast("double").alias("epoch"), get(r'\bcomm="([^"]*)"').alias("command"),
        get(r'\bexe="([^"]*)"').alias("exe"), get(r"\bpid=(\d+)").try_cast("int").alias("pid"), get(r"\buid=(\d+)").try_cast("int").alias("uid"), get(r"\bsuccess=(\w+)").alias("success"), get(r'\bkey="?([\w\-]+)"?').alias("audit_key"),
        get(r'\bname="([^"]*)"').alias("name"), get(r"\bnametype=(\w+)").alias("nametype"),
    ).where("serial is not null and epoch is not null")
    some = lambda c: F.first(c, ignorenulls=True).alias(c)
    path = F.min_by(F.when(F.col("type") == "PATH", F.col("name")), F.when((F.col("type") == "PATH") & F.col("name").isNotNull(), F.when(F.col("nametype").isin("NORMAL", "CREATE"), 0).otherwise(1)))
    kind = F.max(F.when(F.col("nametype") == "CREATE", 1).otherwise(0))
    g = f.groupBy("serial").agg(F.min("epoch").alias("epoch"), F.bool_and(F.col("type") == "CONFIG_CHANGE").alias("config"), path.alias("file_path"), kind.alias("created"), *map(some, ("command", "exe", "pid", "uid", "success", "audit_key")))
    return g.where("not config").select(
        "serial", F.timestamp_seconds("epoch").alias("timestamp"), F.when(F.col("created") == 1, "create").otherwise("access").alias("event_type"), "file_path", "command", "exe", "pid", "uid", (F.col("success") == "yes").alias("success"), "audit_key"
    )


FS_EVENT = "timestamp string, event_type string, file_path string, file_extension string, source string"


def parse_fs(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of file events from JSON lines; blank and damaged lines are left out; MOVED_* is a move."""
    j = lines.where(F.trim(line) != "").select(F.from_json(line, FS_EVENT).alias("j"))
    t = F.when(F.upper("j.event_type").startswith("MOVED"), "move").otherwise(F.lower("j.event_type"))
    return j.select(F.try_to_timestamp("j.timestamp").alias("timestamp"), t.alias("event_type"), "j.file_path", "j.file_extension", "j.source").where("timestamp is not null")


def normalised(fs: DataFrame | None = None, audit: DataFrame | None = None) -> DataFrame:
    """(timestamp, action_type, file_path, actor, raw_event) of either source, types prefixed by it; works on streams too."""
    parts = []
    if fs is not None:
        parts.append(fs.select("timestamp", F.concat(F.lit("fs_"), "event_type").alias("action_type"), "file_path", F.col("source").alias("actor"), F.to_json(F.struct(*fs.columns)).alias("raw_event")))
    if audit is not None:
        parts.append(audit.select("timestamp", F.concat(F.lit("audit_"), "event_type").alias("action_type"), "file_path", F.col("command").alias("actor"), F.to_json(F.struct(*audit.columns)).alias("raw_event")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mine_session(df: DataFrame, key: str, text: str, most: dict[str, int] | None = None) -> DataFrame:
    """(key, models, paths, commands, errors, narrative): distinct finds of a terminal log in order; `most` caps a report's lists by name."""
    caps = most or {}
    t = df.select(key, X.without_ansi(F.col(text)).alias("t"))
    capped = lambda c, n: F.slice(c, 1, caps[n]) if n in caps else c
    finds = [capped(F.array_distinct(F.regexp_extract_all("t", F.lit(p), 1)), n).alias(n) for n, p in SESSION_PATTERNS.items()]
    prose = F.filter(F.split("t", r"\r?\n"), lambda x: (F.length(F.trim(x)) > 40) & ~x.startswith("$ ") & ~F.lower(x).rlike(r"\b(error|exception|traceback|failed)\b"))
    return t.select(key, *finds, capped(prose, "narrative").alias("narrative"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
