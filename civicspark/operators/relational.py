"""Relational building blocks: predicates built from optional parameters, lookups, range joins, merges and paging.

Each returns a lazy DataFrame; none collects rows. Joins carry no hints: sides are broadcast by the optimiser's own
check of their size, or split by AQE where a key is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.session import cut


def where_given(df: DataFrame, **equal: object) -> DataFrame:
    """Equality for every parameter that is not None; the others add no predicate at all."""
    return reduce(lambda x, kv: x.where(F.col(kv[0]) == F.lit(kv[1])), [kv for kv in equal.items() if kv[1] is not None], df)


def tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """Rows of one tenant; a missing id is an error, never all tenants."""
    if not tenant_id:
        raise ValueError("a tenant is required")
    return df.where(F.col("tenant_id") == tenant_id)


def excluding(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose value is not listed; nulls stay (unlike NOT IN)."""
    return df.where(~F.coalesce(F.col(column).isin(values), F.lit(False))) if values else df


def containing(column: Column, part: str | Column) -> Column:
    """Literal substring regardless of case; wildcards have no meaning."""
    return F.contains(F.lower(column), F.lower(F.lit(part) if isinstance(part, str) else part))


def between(df: DataFrame, column: str, start: object = None, end: object = None) -> DataFrame:
    """Inclusive range, open where a bound is None."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df if end is None else df.where(F.col(column) <= F.lit(end))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order (end `order` with a unique key)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def with_child_count(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Every parent with the number of its children, 0 if none; children are counted before the join."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order` (a total order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unseen(df: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not present; null keys are never present."""
    return df.join(present.select(*keys).distinct(), keys, "left_anti")


def seen_by_any(df: DataFrame, checks: list[tuple[str, DataFrame, str]], key: str) -> DataFrame:
    """Keys of df that any check finds: (column of df, table, column of table). Semi-joins, united; no OR in a join."""
    hits = [df.join(t.select(F.col(c).alias(col)).distinct(), col, "left_semi").select(key) for col, t, c in checks]
    return reduce(DataFrame.union, hits).distinct()


def by_interval(df: DataFrame, date: str, roster: DataFrame, start: str = "start", end: str = "end", priority: str = "priority") -> DataFrame:
    """df with the roster row whose closed interval holds the date: the least priority of several, the greatest priority if none does.

    Only the distinct dates are looked up, by an equi-join on the month with the roster cut into months, and then joined back, so
    rows need no identity of their own and repeated dates cost nothing.
    """
    months = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    cells = roster.withColumn("__m", months)
    extra = [c for c in roster.columns if c not in (start, end)]
    days = df.select(F.col(date).alias("__day")).where("__day is not null").distinct().withColumn("__m", F.trunc("__day", "month"))
    hit = days.join(cells, "__m").where(F.col("__day").between(F.col(start), F.col(end)))
    best = hit.groupBy("__day").agg(F.min_by(F.struct(*extra), priority).alias("__r"))
    last = roster.orderBy(F.desc(priority)).limit(1).select(F.struct(*extra).alias("__last"))
    both = df.join(best, F.col(date) == F.col("__day"), "left").join(last, F.lit(True), "left")
    r = F.coalesce("__r", "__last")
    return both.withColumn("__r", r).select(*[df[c] for c in df.columns], *[F.col(f"__r.{c}").alias(c) for c in extra])


def range_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: Column, end: Column, width: float) -> DataFrame:
    """Pairs with equal keys whose right `at` lies in [start, end] of the left row, both bounds included, by an equi-join on buckets of `width`.

    Left rows are repeated for each bucket that their range touches (few if width is near the ranges' length); right rows
    fall into one. start and end are columns of left.
    """
    bucket = F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))
    a = left.withColumn("__s", start).withColumn("__e", end).withColumn("__b", bucket)
    b = right.withColumn("__b", F.floor(F.col(at) / width))
    return a.join(b, [*keys, "__b"]).where((F.col(at) >= F.col("__s")) & (F.col(at) <= F.col("__e"))).drop("__b", "__s", "__e")


def by_position(rows: DataFrame, array: str, found: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Elements of an array joined with rows that name their position (from 0); a missing position means 0, positions beyond the end find nothing."""
    flat = rows.select(*keys, F.posexplode(array).alias(index, "element"))
    return found.withColumn(index, F.coalesce(index, F.lit(0))).join(flat, [*keys, index])


def merge_manifest(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The new listing; an entry keeps its old state if its size is unchanged and it is not pending, else it starts as pending."""
    state = [c for c in old.columns if c not in (key, "size_bytes")]
    o = old.select(key, F.col("size_bytes").alias("__size"), *[F.col(c).alias(f"__{c}") for c in state])
    j = new.select(key, "size_bytes").join(o, key, "left")
    kept = (F.col("__size") == F.col("size_bytes")) & (F.col("__status") != "pending")
    return j.select(key, "size_bytes", *[F.when(kept, F.col(f"__{c}")).otherwise(F.lit("pending") if c == "status" else F.lit(None)).alias(c) for c in state])


def consensus(long: DataFrame, label: str, value: str, backend: str) -> DataFrame:
    """Per label: how many backends answered, their distinct answers in order, and CONSENSUS or DISAGREEMENT."""
    return long.groupBy(label).agg(
        F.count_distinct(backend).alias("backends"), F.array_join(F.array_sort(F.collect_set(value)), "; ").alias("answers"),
        F.when(F.count_distinct(value) <= 1, "CONSENSUS").otherwise("DISAGREEMENT").alias("verdict"),
    )


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Tables with different columns on top of each other; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def in_order(column: Column, values: list[str], otherwise: int = 99) -> Column:
    """The place of a value in a custom order (from 1), `otherwise` if it is not listed."""
    at = F.array_position(F.array(*map(F.lit, values)), column)
    return F.when(at > 0, at).otherwise(otherwise)


def round_robin(df: DataFrame, order: list[Column], n: int, name: str = "part") -> DataFrame:
    """Rows dealt to n parts by their place in `order`.

    Places are counted without a single-task window: rows are range-partitioned in order, counted per partition, and
    numbered from their partition's offset. The partitions' numbers are written once, so both uses see the same ones.
    """
    ranged = df.withColumn("__k", F.struct(*order)).repartitionByRange("__k").sortWithinPartitions("__k")
    tagged = cut(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % (1 << 33)))
    counts = tagged.groupBy("__p").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__o", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return tagged.join(before, "__p").withColumn(name, F.pmod(F.col("__i") + F.col("__o"), F.lit(n))).drop("__k", "__p", "__i", "__c", "__o")
