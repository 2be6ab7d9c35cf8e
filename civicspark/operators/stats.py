"""Two-sample statistics, trends and multiple comparisons. Sums stay in the JVM; only p-values use a small Arrow function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _betacf(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def student_p_value(t: float, df: float) -> float:
    """Two-sided."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    return betainc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


@pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_p_value(a, b) for a, b in zip(t, df, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided."""
    return pd.Series([math.erfc(abs(x) / math.sqrt(2)) if x is not None and not np.isnan(x) else math.nan for x in z], dtype=float)


def describe(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.var_samp(value).alias("variance"))


def _two(df: DataFrame, groups: list[str], value: str, first: Column) -> DataFrame:
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    return df.groupBy(*groups).agg(F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"), F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2"))


def welch(df: DataFrame, groups: list[str], value: str, first: Column) -> DataFrame:
    """Per group: n1, m1, n2, m2, t, df, p and Cohen's d of rows where `first` is true against the others; null with fewer than two rows a side."""
    s = _two(df, groups, value, first)
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2))
    dof = F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    d = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt((F.col("v1") + F.col("v2")) / 2))
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    out = s.select(*groups, "n1", "m1", "n2", "m2", F.when(ok, t).alias("t"), F.when(ok, dof).alias("df"), F.when(ok, d).alias("cohens_d"))
    return out.withColumn("p", student_p("t", "df"))


def mann_whitney(df: DataFrame, groups: list[str], value: str, first: Column) -> DataFrame:
    """Per group: u1, n1, n2 and the two-sided p by normal approximation with correction for ties and continuity.

    Values are counted first; the running count over distinct values is a sum in slices of the value range whose totals are
    added up before, so neither rows nor distinct values of a group are sorted in one task.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("v")).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    edge = c.groupBy(*groups).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    c = c.join(edge, groups) if groups else c.join(edge)
    c = c.withColumn("s", F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("lo")) * 1024, F.col("hi") - F.col("lo"))), F.lit(0)))
    up = Window.unboundedPreceding
    coarse = c.groupBy(*groups, "s").agg(F.sum("b").alias("bs"))
    coarse = coarse.withColumn("below", F.coalesce(F.sum("bs").over(Window.partitionBy(*groups).orderBy("s").rowsBetween(up, -1)), F.lit(0)))
    fine = c.withColumn("inside", F.coalesce(F.sum("b").over(Window.partitionBy(*groups, "s").orderBy("v").rowsBetween(up, -1)), F.lit(0)))
    j = fine.join(coarse, [*groups, "s"])
    n = F.col("a") + F.col("b")
    g = j.groupBy(*groups).agg(F.sum(F.col("a") * (F.col("below") + F.col("inside") + F.col("b") / 2)).alias("u1"), F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum((n * n * n - n).cast("double")).alias("ties"))
    total = F.col("n1") + F.col("n2")
    mu = F.col("n1") * F.col("n2") / 2
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u1") - mu) - 0.5, F.lit(0.0)), sigma)
    return g.select(*groups, "u1", "n1", "n2", normal_p(z).alias("p"))


def holm(df: DataFrame, groups: list[str], p: str, alpha: float = 0.05, compat: bool = False) -> DataFrame:
    """df with threshold and rejected: step-down, so that nothing is rejected after the first failure; compat compares each alone."""
    w = Window.partitionBy(*groups).orderBy(p, *[c for c in df.columns if c not in (*groups, p)])
    m = F.count("*").over(Window.partitionBy(*groups))
    t = df.withColumn("threshold", F.lit(alpha) / (m - F.row_number().over(w) + 1))
    alone = F.col(p) < F.col("threshold")
    if compat:
        return t.withColumn("rejected", alone)
    return t.withColumn("rejected", F.min(alone).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def trend(df: DataFrame, groups: list[str], x: str, y: str, level: float = 0.05) -> DataFrame:
    """slope, intercept, r2, n, p and direction (increasing, decreasing, stable) of y over x."""
    g = df.groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    t = F.when(F.col("r2") < 1, F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))).otherwise(F.lit(float("inf")))
    g = g.withColumn("p", F.when(F.col("n") > 2, student_p(t, (F.col("n") - 2).cast("double"))))
    return g.withColumn("direction", F.when(F.col("p").isNull() | F.isnan("p") | (F.col("p") >= level), "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing"))


def rolling_mean(df: DataFrame, groups: list[str], order: str, value: str, width: int = 5) -> DataFrame:
    """The mean of up to `width` values so far, and the days since the group's first."""
    w = Window.partitionBy(*groups).orderBy(order)
    return df.withColumn("rolling", F.avg(value).over(w.rowsBetween(1 - width, 0))).withColumn("days", F.datediff(order, F.min(order).over(Window.partitionBy(*groups))))


def peers(counts: DataFrame, name: str, n: str, target: str, least: int = 3) -> DataFrame:
    """All but the target with `least` or more; if there are none, all but the target.

    The target is the name as given, else the least name that contains it in any case; if there is none, there are no peers.
    """
    exact, part = F.col(name) == target, F.contains(F.lower(F.col(name)), F.lit(target.lower()))
    found = counts.agg(F.coalesce(F.min(F.when(exact, F.col(name))), F.min(F.when(part, F.col(name)))).alias("__target")).where("__target is not null")
    others = counts.join(F.broadcast(found), F.lit(True)).where(F.col(name) != F.col("__target")).drop("__target")
    many = others.where(F.col(n) >= least)
    none = many.agg(F.count("*").alias("k")).where("k = 0").drop("k")
    return many.union(others.join(none.withColumn("__one", F.lit(1)), F.lit(True)).select(*others.columns))


def per_turn(count: Column, turns: Column) -> Column:
    """A rate per turn; no turns count as one."""
    return count / F.coalesce(F.nullif(turns, F.lit(0)), F.lit(1))
