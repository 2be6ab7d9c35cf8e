"""Queries of the roll-ups, over orders, line items and customers in the place of statistical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.operators import rollups as U
from civicspark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey")


_O = "o AS (SELECT year(o_orderdate) AS y, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, o_custkey FROM orders)"


@query(f"WITH {_O} SELECT y, o_orderpriority, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM o GROUP BY ALL")
def first_and_last_wins(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    a = U.first_per(o, ["y", "o_orderpriority"], "o_orderkey", ["o_totalprice"]).withColumnRenamed("o_totalprice", "first_price")
    return a.join(U.last_per(o, ["y", "o_orderpriority"], "o_orderkey", ["o_totalprice"]).withColumnRenamed("o_totalprice", "last_price"), ["y", "o_orderpriority"])


@query(f"""
    WITH {_O}, t AS (SELECT y, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS p FROM o WHERE y = (SELECT max(y) FROM o) GROUP BY 1)
    SELECT y, 'f' AS part, CAST(f AS DOUBLE) AS value, round(100.0 * f / total, 1) AS pct FROM t UNION ALL SELECT y, 'p', p, round(100.0 * p / total, 1) FROM t""")
def latest_slice_share(s: SparkSession, d: str) -> DataFrame:
    t = _orders(s, d).groupBy("y").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("p"))
    return U.shares(U.latest_slice(t, "y"), ["f", "p"], "total", ["y"])


_CHANGE = f"""WITH {_O}, t AS (SELECT o_orderpriority, y, count(*) AS n FROM o GROUP BY ALL), c AS (SELECT o_orderpriority, arg_min(n, y) AS first_value, arg_max(n, y) AS last_value, min(y) AS first_year, max(y) AS last_year, max(n) AS peak FROM t GROUP BY 1)"""


@query(f"{_CHANGE} SELECT *, last_value - first_value AS delta, CASE WHEN last_value > first_value THEN '+' WHEN last_value < first_value THEN '-' ELSE '' END AS sign, round(100.0 * (last_value - first_value) / first_value, 1) AS pct_change, peak > 1.3 * first_value AS peaked FROM c")
def first_last_delta(s: SparkSession, d: str) -> DataFrame:
    return U.change(_orders(s, d).groupBy("o_orderpriority", "y").agg(F.count("*").alias("n")), ["o_orderpriority"], "y", "n")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_discount), 2) AS numerator, round(sum(l_extendedprice), 2) AS denominator, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS rate FROM lineitem GROUP BY ALL")
def rate_by_group(s: SparkSession, d: str) -> DataFrame:
    r = U.rates(table(s, d, "lineitem").withColumn("num", F.col("l_extendedprice") * F.col("l_discount")), ["l_returnflag", "l_linestatus"], "num", "l_extendedprice")
    return r.select("l_returnflag", "l_linestatus", F.round("numerator", 2).alias("numerator"), F.round("denominator", 2).alias("denominator"), F.round("rate", 6).alias("rate"))


@query("""
    SELECT c_mktsegment, count(*) AS n, row_number() OVER (ORDER BY coalesce(NULLIF(list_position(['MACHINERY', 'BUILDING'], c_mktsegment), 0), 3), c_mktsegment) AS place FROM customer GROUP BY 1""")
def ordered_histogram(s: SparkSession, d: str) -> DataFrame:
    return U.histogram(table(s, d, "customer"), "c_mktsegment", ["MACHINERY", "BUILDING"])


@query(f"WITH {_O} SELECT y, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM o GROUP BY 1")
def year_domain_pivot(s: SparkSession, d: str) -> DataFrame:
    x = U.pivoted(_orders(s, d).withColumn("one", F.lit(1)), "y", "o_orderstatus", "one", ["F", "O", "P"])
    return x.select("y", *[F.coalesce(F.col(c.upper()), F.lit(0)).alias(c) for c in "fop"])


@query("""
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL), ', ') AS flags FROM orders""")
def flags_list(s: SparkSession, d: str) -> DataFrame:
    f = U.flags([(F.col("o_totalprice") > 200000, "large"), (F.col("o_orderstatus") == "O", "open"), (F.col("o_orderpriority").startswith("1"), "urgent")])
    return table(s, d, "orders").select("o_orderkey", f.alias("flags"))


@query(f"WITH {_O} SELECT y, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS high, count(*) FILTER (o_totalprice BETWEEN 50000 AND 150000) AS medium, count(*) FILTER (o_totalprice < 50000) AS low, count(DISTINCT o_custkey) AS customers FROM o GROUP BY 1")
def conditional_histogram(s: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return _orders(s, d).groupBy("y").agg(F.count("*").alias("n"), F.count_if(p > 150000).alias("high"), F.count_if(p.between(50000, 150000)).alias("medium"), F.count_if(p < 50000).alias("low"), F.count_distinct("o_custkey").alias("customers"))


@query("""
    SELECT name, count(*) AS mentions, count(DISTINCT document_id) AS documents, max(day) AS latest FROM (SELECT id AS chunk, document_id, TRY_CAST(metadata.meeting_date AS DATE) AS day, unnest(regexp_extract_all(content, 'Member ([A-Z][a-zA-Z]+)', 1)) AS name FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1) GROUP BY 1""")
def name_frequency(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").dropDuplicates(["id"]).select("document_id", F.to_date(F.try_to_timestamp("metadata.meeting_date")).alias("day"), F.explode(F.regexp_extract_all("content", F.lit("Member ([A-Z][a-zA-Z]+)"), 1)).alias("name"))
    return c.groupBy("name").agg(F.count("*").alias("mentions"), F.count_distinct("document_id").alias("documents"), F.max("day").alias("latest"))


@query("""
    SELECT name, count(*) FILTER (document_type = 'agenda') AS agenda, count(*) FILTER (document_type = 'email') AS email FROM (SELECT document_type, unnest(regexp_extract_all(content, 'Member ([A-Z][a-zA-Z]+)', 1)) AS name FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1) GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 10""")
def name_crosstab(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").dropDuplicates(["id"]).select("document_type", F.explode(F.regexp_extract_all("content", F.lit("Member ([A-Z][a-zA-Z]+)"), 1)).alias("name"))
    g = c.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("document_type") == "agenda").alias("agenda"), F.count_if(F.col("document_type") == "email").alias("email"))
    return g.orderBy(F.desc("n"), "name").limit(10).select("name", "agenda", "email")


@query("""
    WITH s AS (SELECT id, length(content_text) AS n, row_number() OVER (ORDER BY length(content_text), id) AS r, count(*) OVER () AS c, row_number() OVER (ORDER BY abs(length(content_text) - 1500), length(content_text), id) AS near FROM document_records WHERE content_text IS NOT NULL)
    SELECT DISTINCT id, n FROM s WHERE near = 1 OR r = (c + 1) // 2 OR r = c""")
def sample_sizes(s: SparkSession, d: str) -> DataFrame:
    """The record nearest to 1,500 characters, the median one and the longest."""
    r = table(s, d, "document_records").where("content_text is not null").select("id", F.length("content_text").alias("n"))
    near = r.orderBy(F.abs(F.col("n") - 1500), "n", "id").limit(1)
    longest = r.orderBy(F.desc("n"), F.desc("id")).limit(1)
    by_size = r.groupBy("n").agg(F.count("*").alias("k"))
    median = r.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("n"))
    below = by_size.join(median.withColumnRenamed("n", "m")).where("n < m").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("below"))
    total = r.agg(F.count("*").alias("c"))
    tied = r.join(median, "n").join(below).join(total)
    mid = tied.withColumn("rn", F.row_number().over(Window.partitionBy("n").orderBy("id")) + F.col("below")).where("rn = int((c + 1) / 2)").select("id", "n")
    return near.union(mid).union(longest).distinct()
