"""Corpus diagnostics: document classes from page classes, reading-time estimates and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NATIVE_PAGES_PER_MIN, SCANNED_PAGES_PER_MIN = 200.0, 3.0


def classify_documents(pages: DataFrame, doc: str, kind: str) -> DataFrame:
    """(doc, pages, rich, sparse, image, unreadable, class, ocr_minutes)."""
    n = lambda k: F.count_if(F.col(kind) == k).alias(k.lower().removeprefix("text_").removesuffix("_only"))
    g = pages.groupBy(doc).agg(F.count("*").alias("pages"), n("TEXT_RICH"), n("TEXT_SPARSE"), n("IMAGE_ONLY"), n("UNREADABLE"))
    ratio = F.col("rich") / F.col("pages")
    c = F.when(F.col("unreadable") == F.col("pages"), "EMPTY").when(ratio >= 0.9, "NATIVE_DIGITAL").when(ratio >= 0.1, "MIXED_CONTENT").otherwise("FULLY_SCANNED")
    return g.withColumn("class", c).withColumn("ocr_minutes", F.round(F.col("rich") / NATIVE_PAGES_PER_MIN + (F.col("image") + F.col("sparse")) / SCANNED_PAGES_PER_MIN, 3))


def profile(df: DataFrame, group: str, size: str) -> DataFrame:
    """(group, n, pct, total, mean, most) over all groups."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.avg(size).alias("mean"), F.max(size).alias("most"))
    every = Window.partitionBy(F.lit(1))  # over the groups, not the rows
    return g.withColumn("pct", 100 * F.col("n") / F.sum("n").over(every))


def ocr_scenarios(docs: DataFrame) -> DataFrame:
    """(scenario, minutes): the estimate and its 0.8 and 1.5 fold."""
    total = docs.agg(F.sum("ocr_minutes").alias("m"))
    return total.select(F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), (F.col("m") * f).alias("minutes")) for n, f in (("low", 0.8), ("expected", 1.0), ("high", 1.5))])).alias("x")).select("x.*")


def service_stats(df: DataFrame, source: str, millis: str) -> DataFrame:
    """(source, n, mean_ms): calls and mean latency by source; calls without a time count but have no part in the mean."""
    return df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), F.avg(millis).alias("mean_ms"))


def throughput(done: DataFrame, at: str, left: int | Column, minutes: float | None = None) -> DataFrame:
    """(n, per_minute, eta_minutes) of a run: what is done over the time from its first to its last `at`, and how long the rest will take.

    `minutes` gives the elapsed time instead. Null where no time has passed.
    """
    elapsed = F.lit(minutes) if minutes is not None else (F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))) / 60e6
    g = done.agg(F.count("*").alias("n"), F.try_divide(F.count("*"), elapsed).alias("per_minute"))
    return g.withColumn("eta_minutes", F.try_divide(left if isinstance(left, Column) else F.lit(left), F.col("per_minute")))
