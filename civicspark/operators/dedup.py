"""Exact duplicates, revisions, low-value rows and what to purge. Groups are aggregated by hash, never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import low_value


def content_key(content: Column, title: Column) -> list[Column]:
    """The two parts that make rows equal: content hash and title (a null title is '')."""
    return [F.sha2(F.coalesce(content, F.lit("")), 256).alias("content_hash"), F.coalesce(title, F.lit("")).alias("group_title")]


def duplicate_groups(df: DataFrame, content: str, title: str, date: str) -> DataFrame:
    """(content_hash, group_title, n, removable, first_date, last_date, dates) of groups of two rows or more."""
    keyed = df.select(*content_key(F.col(content), F.col(title)), F.col(date).cast("string").alias("d"))
    g = keyed.groupBy("content_hash", "group_title").agg(F.count("*").alias("n"), F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.array_join(F.array_sort(F.collect_set("d")), ",").alias("dates"))
    return g.where("n > 1").withColumn("removable", F.col("n") - 1)


def keepers(df: DataFrame, content: str, title: str, date: str, index: str, key: str) -> DataFrame:
    """Every row of a duplicate group with the id that is kept: earliest date (null last), least index (null last), least id.

    One aggregation finds the keeper and one join brings it back, so a group with a third of all rows is not one task's sort.
    """
    order = F.struct(F.coalesce(F.col(date).cast("string"), F.lit("9999")).alias("d"), F.coalesce(F.col(index), F.lit(999999)).alias("i"), F.col(key).alias("k"))
    keyed = df.select(F.col(key), *content_key(F.col(content), F.col(title)), order.alias("o"))
    g = keyed.groupBy("content_hash", "group_title").agg(F.count("*").alias("n"), F.min("o").alias("least")).where("n > 1")
    return keyed.join(g, ["content_hash", "group_title"]).select(key, F.col("least.k").alias("kept_id"), (F.col("o") == F.col("least")).alias("kept"))


def revisions(df: DataFrame, content: str, title: str, date: str) -> DataFrame:
    """Titles with more than one content: (title, versions, first_date, last_date), in one pass."""
    t = df.where(F.coalesce(F.col(title), F.lit("")) != "")
    return t.groupBy(F.col(title).alias("title")).agg(F.count_distinct(F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).alias("versions"), F.min(date).alias("first_date"), F.max(date).alias("last_date")).where("versions > 1")


def purge_log(df: DataFrame, content: str, title: str, date: str, index: str, key: str) -> DataFrame:
    """(id, reason, kept_id): 'duplicate' before 'short' before 'blank'; header-only rows are counted elsewhere but stay."""
    dup = keepers(df, content, title, date, index, key).where("not kept").select(F.col(key).alias("id"), F.lit("duplicate").alias("reason"), "kept_id")
    low = df.select(F.col(key).alias("id"), low_value(F.col(content), F.col(title)).alias("reason")).where("reason in ('short', 'blank')")
    return dup.union(low.join(dup, "id", "left_anti").select("id", "reason", F.lit(None).cast("string")))


def purged(df: DataFrame, log: DataFrame, key: str) -> DataFrame:
    return df.join(log.select(F.col("id").alias(key)), key, "left_anti")


def first_occurrence(df: DataFrame, keys: list[Column], position: list[Column]) -> DataFrame:
    """The first row of each key in position order."""
    w = Window.partitionBy(*keys).orderBy(*position)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unlike_names(df: DataFrame, stem: str, key: str, name: str = "name") -> DataFrame:
    """Stems that collide get four hex digits of their key's md5; the least key keeps its stem. Keys are unique.

    The least key is an aggregate joined back, so a stem with a third of all rows is never one task's sort.
    """
    least = df.groupBy(stem).agg(F.min(key).alias("__least"))
    suffixed = F.concat(stem, F.lit("-"), F.left(F.md5(F.col(key)), F.lit(4)))
    return df.join(least, stem).withColumn(name, F.when(F.col(key) == F.col("__least"), F.col(stem)).otherwise(suffixed)).drop("__least")


def copies_distribution(df: DataFrame, keys: list[Column]) -> DataFrame:
    """(copies, groups): how many keys occur how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("groups"))
