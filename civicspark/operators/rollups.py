"""Roll-ups of statistical tables; the named reports (reports.py) are declared over these and steps of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], position: str, values: list[str]) -> DataFrame:
    """The first row's values per key, by an explicit position."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), position).alias("r")).select(*keys, "r.*")


def last_per(df: DataFrame, keys: list[str], position: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), position).alias("r")).select(*keys, "r.*")


def latest_slice(df: DataFrame, year: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of the latest year (of each key); found by an aggregate and a join, not by a window over all rows."""
    top = df.groupBy(*(keys or [])).agg(F.max(year).alias(year))
    return df.join(top, [*(keys or []), year], "left_semi")


def shares(df: DataFrame, parts: list[str], total: str, keys: list[str]) -> DataFrame:
    """(keys, part, value, pct): columns turned into rows with their share of `total`."""
    long = df.select(*keys, total, F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("value")) for p in parts])).alias("x"))
    return long.select(*keys, "x.part", "x.value", F.round(F.try_divide(100 * F.col("x.value"), F.col(total)), 1).alias("pct"))


def change(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """first, last, delta, sign, pct change, peak and whether the peak is above 1.3 times the first value."""
    g = df.groupBy(*keys).agg(F.min_by(value, year).alias("first_value"), F.max_by(value, year).alias("last_value"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.max(value).alias("peak"))
    d = F.col("last_value") - F.col("first_value")
    return g.select("*", d.alias("delta"), F.when(d > 0, "+").when(d < 0, "-").otherwise("").alias("sign"), F.round(F.try_divide(100 * d, F.col("first_value")), 1).alias("pct_change"), (F.col("peak") > 1.3 * F.col("first_value")).alias("peaked"))


def rates(df: DataFrame, keys: list[str], num: str, den: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.sum(num).alias("numerator"), F.sum(den).alias("denominator"))
    return g.withColumn("rate", F.coalesce(F.try_divide(F.col("numerator"), F.col("denominator")), F.lit(0.0)))


def histogram(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, n, place): places of a custom order first, the rest alphabetically after them."""
    g = df.groupBy(value).agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, order)), F.col(value))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.when(at > 0, at).otherwise(len(order) + 1), value)))


def pivoted(df: DataFrame, key: str, column: str, value: str, values: list[str]) -> DataFrame:
    """One column per listed value (listing them saves a pass over the data)."""
    return df.groupBy(key).pivot(column, values).agg(F.sum(value))


def flags(pairs: list[tuple[Column, str]]) -> Column:
    """The names whose condition holds, in order, joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in pairs])), ", ")


def either(df: DataFrame, *names: str) -> Column:
    """The first of several columns that the table has (the names vary by year); null if it has none."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")
