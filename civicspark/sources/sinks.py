"""Writers: insert-ignore, merge, replace, delete and append, as new versions of Parquet tables.

A table is a folder of version folders. What is published stands in numbered files of a log folder: each names the tables'
versions, is complete before it gets its name by one rename, and is never changed or deleted, so a reader sees all tables of one
publication or none of them, and never a table without a version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _parent(table: str) -> str:
    return table.rstrip("/").rsplit("/", 1)[0]


def _published(spark: SparkSession, log: str) -> tuple[int, dict[str, str]]:
    """(number of the last publication, versions by table name) of a folder of tables; each file lists all its tables."""
    fs, p = _fs(spark, f"{log}/_published")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    last = max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)
    if last < 0:
        return -1, {}
    fs, p = _fs(spark, f"{log}/_published/{last:012d}.json")
    s = fs.open(p)
    try:
        return last, json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8"))
    finally:
        s.close()


def current(spark: SparkSession, table: str) -> str | None:
    """The folder of the table's published version."""
    name = table.rstrip("/").rsplit("/", 1)[1]
    v = _published(spark, _parent(table))[1].get(name)
    return f"{table}/{v}" if v else None


def read(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    path = current(spark, table)
    if path is None:
        if schema is None:
            raise FileNotFoundError(table)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def publish(tables: dict[str, DataFrame], partition_by: list[str] | None = None, tries: int = 20) -> None:
    """Write all tables, which share a parent folder, then publish their new versions together by one rename.

    Two writers that publish at once are told apart by the number: a rename onto an existing file fails, and the loser, whose
    versions stand, goes on from what the winner published.
    """
    spark = next(iter(tables.values())).sparkSession
    if len(logs := {_parent(t) for t in tables}) > 1:
        raise ValueError(f"tables of several folders: {sorted(logs)}")
    new = {}
    for t, df in tables.items():
        v = f"v-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{t}/{v}")
        new[t.rstrip("/").rsplit("/", 1)[1]] = v
    log = logs.pop()
    for _ in range(tries):
        last, old = _published(spark, log)
        fs, tmp = _fs(spark, f"{log}/_published/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(old | new).encode()))
        out.close()
        goal = _fs(spark, f"{log}/_published/{last + 1:012d}.json")[1]
        if not fs.exists(goal) and fs.rename(tmp, goal):
            return
        fs.delete(tmp, False)
    raise RuntimeError("other writers published at every try")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of new whose key target lacks, one per key (the least by `order`). Null keys conflict with nothing, as in SQL."""
    has_null = " or ".join(f"`{k}` is null" for k in keys)
    keyed = new.where(f"not ({has_null})")
    if order:
        keyed = keyed.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    else:
        keyed = keyed.dropDuplicates(keys)
    return keyed.join(target.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new.where(has_null))


def merge_metadata(target: DataFrame, changes: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    """target with the maps of changes laid over its own; keys of changes win."""
    c = changes.select(key, F.col(column).alias("__new"))
    j = target.join(c, key, "left")
    old = F.coalesce(column, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False)))
    return j.withColumn(column, F.when(F.col("__new").isNull(), F.col(column)).otherwise(F.map_concat(kept, "__new"))).drop("__new").select(*target.columns)


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent: rows of new replace those with their key."""
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_children(target: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new are those of new."""
    return target.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def delete_ids(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key).distinct(), key, "left_anti")


def with_status(rows: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Status derived from what is there, not stored: complete, failed (with its error) or pending."""
    d = done.select(key).distinct().withColumn("__d", F.lit(True))
    f = failed.groupBy(key).agg(F.max("error").alias("error"))
    j = rows.join(d, key, "left").join(f, key, "left")
    return j.withColumn("status", F.when(F.col("__d"), "complete").when(F.col("error").isNotNull(), "failed").otherwise("pending")).drop("__d")


def point_id(*columns: str) -> object:
    """A deterministic id of a vector point, so that a repeated run overwrites instead of adding."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)


def write_csv_union(parts: list[DataFrame], path: str) -> None:
    """One CSV of several tables; columns in the order first seen."""
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.select(*names).write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are written as null, so every line has all columns."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)
