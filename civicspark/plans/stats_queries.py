"""Queries of statistics and trends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import stats as S
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


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SERIES = """s AS (SELECT DISTINCT profile_id, name, tenant_id, unnest(meetings) AS day, unnest(speaking_share_pct) AS share, unnest(mean_wpm) AS wpm FROM speaker_profiles)"""


def _series(s: SparkSession, d: str) -> DataFrame:
    z = F.arrays_zip("meetings", "speaking_share_pct", "mean_wpm")
    p = table(s, d, "speaker_profiles").select("profile_id", "name", "tenant_id", F.explode(z).alias("z"))
    return p.select("profile_id", "name", "tenant_id", F.col("z.meetings").alias("day"), F.col("z.speaking_share_pct").alias("share"), F.col("z.mean_wpm").alias("wpm")).distinct()


@query("SELECT l_returnflag AS g, count(*) AS n FROM lineitem GROUP BY 1")
def sample_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def describe_groups(s: SparkSession, d: str) -> DataFrame:
    return _rounded(S.describe(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity"))


_WELCH = """a AS (SELECT l_linestatus, count(l_quantity) FILTER (l_returnflag = 'A') AS n1, avg(l_quantity) FILTER (l_returnflag = 'A') AS m1, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS v1,
        count(l_quantity) FILTER (l_returnflag <> 'A') AS n2, avg(l_quantity) FILTER (l_returnflag <> 'A') AS m2, var_samp(l_quantity) FILTER (l_returnflag <> 'A') AS v2 FROM lineitem GROUP BY 1)"""


@query(f"WITH {_WELCH} SELECT l_linestatus, n1, round(m1, 6) AS m1, n2, round(m2, 6) AS m2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 3) AS df FROM a")
def welch_t(s: SparkSession, d: str) -> DataFrame:
    w = S.welch(table(s, d, "lineitem"), ["l_linestatus"], "l_quantity", F.col("l_returnflag") == "A")
    return _rounded(w.drop("p", "cohens_d")).withColumn("df", F.round("df", 3))


@query()
def welch_p(s: SparkSession, d: str) -> DataFrame:
    return S.welch(table(s, d, "lineitem"), ["l_linestatus"], "l_quantity", F.col("l_returnflag") == "A").select("l_linestatus", "t", "p")


@query(f"WITH {_WELCH} SELECT l_linestatus, round((m1 - m2) / sqrt((v1 + v2) / 2), 6) AS cohens_d FROM a")
def cohens_d(s: SparkSession, d: str) -> DataFrame:
    return _rounded(S.welch(table(s, d, "lineitem"), ["l_linestatus"], "l_quantity", F.col("l_returnflag") == "A").select("l_linestatus", "cohens_d"))


@query("""
    WITH r AS (SELECT l_linestatus, l_returnflag = 'A' AS a, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2.0 AS k FROM lineitem)
    SELECT l_linestatus, sum(k) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0 AS u1, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2 FROM r GROUP BY 1""")
def mann_whitney_u(s: SparkSession, d: str) -> DataFrame:
    return S.mann_whitney(table(s, d, "lineitem"), ["l_linestatus"], "l_quantity", F.col("l_returnflag") == "A").drop("p")


@query("""
    WITH p AS (SELECT o_orderkey % 50 AS grp, o_orderkey AS k, (o_orderkey * 7919 % 10007) / 10007.0 * 0.02 AS p FROM orders),
         t AS (SELECT *, 0.05 / (count(*) OVER (PARTITION BY grp) - row_number() OVER (PARTITION BY grp ORDER BY p, k) + 1) AS threshold FROM p)
    SELECT grp, k, bool_and(p < threshold) OVER (PARTITION BY grp ORDER BY p, k) AS rejected FROM t""")
def holm(s: SparkSession, d: str) -> DataFrame:
    """Holm's procedure over every order, in fifty families."""
    o = table(s, d, "orders").select((F.col("o_orderkey") % 50).alias("grp"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7919 % 10007 / 10007.0 * 0.02).alias("p"))
    return S.holm(o, ["grp"], "p").select("grp", "k", "rejected")


@query(f"WITH {_SERIES} SELECT name, tenant_id, count(*) AS n, round(regr_slope(share, day - DATE '2015-01-01'), 9) AS slope FROM s GROUP BY ALL HAVING count(DISTINCT day) > 2")
def trend_slopes(s: SparkSession, d: str) -> DataFrame:
    x = _series(s, d).withColumn("x", F.datediff("day", F.lit("2015-01-01").cast("date")))
    many = x.groupBy("name", "tenant_id").agg(F.count_distinct("day").alias("k")).where("k > 2").drop("k")
    t = S.trend(x.join(many, ["name", "tenant_id"], "left_semi"), ["name", "tenant_id"], "x", "share")
    return t.select("name", "tenant_id", "n", F.round("slope", 9).alias("slope"))


@query()
def trend_regression(s: SparkSession, d: str) -> DataFrame:
    """Slope, fit, p-value and direction of every speaker's share of speech."""
    return S.trend(_series(s, d).withColumn("x", F.datediff("day", F.lit("2015-01-01").cast("date"))), ["name", "tenant_id"], "x", "share")


@query("""
    WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, CAST(round(sum(o_totalprice)) AS BIGINT) AS v FROM orders GROUP BY ALL)
    SELECT o_custkey, day, round(avg(v) OVER (PARTITION BY o_custkey ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 2) AS rolling, day - min(day) OVER (PARTITION BY o_custkey) AS days FROM o""")
def rolling_mean(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice")).cast("bigint").alias("v"))
    return S.rolling_mean(o, ["o_custkey"], "day", "v").select("o_custkey", "day", F.round("rolling", 2).alias("rolling"), "days")


@query("""
    WITH c AS (SELECT name, max(len(meetings)) AS n FROM speaker_profiles GROUP BY 1),
         t AS (SELECT coalesce(min(name) FILTER (name = 'Grettasby'), min(name) FILTER (contains(lower(name), 'grettasby'))) AS target FROM c), o AS (SELECT c.* FROM c, t WHERE name <> target)
    SELECT name, n FROM o WHERE n >= 3 OR NOT EXISTS (SELECT 1 FROM o WHERE n >= 3)""")
def peer_selection(s: SparkSession, d: str) -> DataFrame:
    """The target is asked for by a part of its name."""
    c = table(s, d, "speaker_profiles").groupBy("name").agg(F.max(F.size("meetings")).alias("n"))
    return S.peers(c, "name", "n", "Grettasby")


@query("""
    SELECT DISTINCT profile_id, list_transform(list_zip(total_words, turn_count), lambda z: round(z[1] / CASE WHEN z[2] = 0 OR z[2] IS NULL THEN 1 ELSE z[2] END, 6))[1] AS words_per_turn FROM speaker_profiles""")
def words_per_turn(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "speaker_profiles").select("profile_id", F.get("total_words", F.lit(0)).alias("w"), F.get("turn_count", F.lit(0)).alias("t")).distinct()
    return p.select("profile_id", F.round(S.per_turn(F.col("w"), F.col("t")), 6).alias("words_per_turn"))
