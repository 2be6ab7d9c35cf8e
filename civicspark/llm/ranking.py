"""One ranking from several scores on different scales, by a random walk over ranks.

From an item the walk picks one of the legs (all alike), then draws an item uniformly and jumps there if the leg ranks
it higher; otherwise it stays. Jumps are thus uniform over the higher-ranked items, and an item is held the longer, the
fewer stand above it. With probability 1 - damping a step starts anew anywhere, so that an item on top of all
legs does not absorb the walk. Items in order of stationary mass are the ranking; only ranks enter, so no scale can
dominate, and an item that one leg alone puts first does not stay first. An item that a leg did not return stands,
in this leg, below all that it did (all such items tie).

The stationary mass is found by power iteration over the jumps alone (mass over holding rate), which needs one suffix
sum of mass over rank order per leg and settles in a few dozen rounds, since each jump about halves a rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.session import cut

DAMPING = 0.95
ROUNDS = 60
#: Relative change of a mass at which the iteration ends, and the significant digits in which masses are compared.
TOLERANCE, DIGITS = 1e-13, 10
#: Rows of one query that one task may hold; larger queries are ranked by distributed prefix sums.
TASK_ROWS = 500_000
#: Width of a rank bucket of the distributed prefix sums.
BUCKET = 20_000


def legs_long(df: DataFrame, query: str, item: str, ranks: str, scores: str) -> DataFrame:
    """(query, item, leg, place): the least rank of each leg; a leg without a rank is placed by its score.

    The score's direction in a query's leg is that of its ranked rows (higher is better if that can't be told). Null and
    NaN scores without a rank do not place an item. Rows repeated for an item count once.
    """
    base = df.select(F.col(query).alias("q"), F.col(item).alias("i"), F.col(ranks).alias("r"), F.col(scores).alias("s")).where("q is not null and i is not null")
    legs = F.explode(F.array_union(F.coalesce(F.map_keys("r"), F.array().cast("array<string>")), F.coalesce(F.map_keys("s"), F.array().cast("array<string>"))))
    long = base.select("q", "i", "r", "s", legs.alias("leg")).select("q", "i", "leg", F.try_element_at("r", F.col("leg")).alias("rank"), F.try_element_at("s", F.col("leg")).alias("score"))
    long = long.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).groupBy("q", "i", "leg").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    return long.where("rank is not null or score is not null")


def walk(above: np.ndarray, damping: float = DAMPING, rounds: int = ROUNDS, tol: float = TOLERANCE) -> np.ndarray:
    """Stationary mass; above[item, leg] is the number of items that the leg ranks strictly higher.

    Ends when no mass changes by more than tol of itself, whatever the number of items.
    """
    n, legs = above.shape
    orders = [np.argsort(above[:, k], kind="stable") for k in range(legs)]
    ends = [np.searchsorted(above[o, k], above[o, k], side="right") for k, o in enumerate(orders)]
    restart = (1 - damping) / damping * n  # in ranks: a step's chance to jump is the items above over n
    rate = above.sum(1) / legs + restart
    p = np.full(n, 1 / n)
    for _ in range(rounds):
        new = np.full(n, restart * p.sum() / n)
        for o, end in zip(orders, ends, strict=True):
            below = np.concatenate((np.cumsum(p[o][::-1])[::-1], [0.0]))
            new[o] += below[end] / legs
        new /= rate
        new /= new.sum()
        done = np.abs(new - p).max() == 0 or (np.abs(new - p) / new).max() < tol
        p = new
        if done:
            break
    return p


def _places(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    items, i = np.unique(g["i"].to_numpy(), return_inverse=True)
    legs, k = np.unique(g["leg"].to_numpy(), return_inverse=True)
    out = np.zeros((len(items), len(legs)))
    rank, score = g["rank"].to_numpy(float), g["score"].to_numpy(float)
    for leg in range(len(legs)):
        at = np.flatnonzero(k == leg)
        out[:, leg] = len(at)
        key = rank[at].copy()
        both = at[~np.isnan(rank[at]) & ~np.isnan(score[at])]
        lone = np.isnan(key)
        if lone.any():
            up = len(both) < 2 or np.ptp(score[both]) == 0 or np.corrcoef(rank[both], score[both])[0, 1] <= 0
            s = np.where(up, -score, score)
            if len(both):
                o = both[np.lexsort((rank[both], s[both]))]  # of equal scores the last counts from above, the first from below
                key[lone] = np.interp(s[at[lone]], s[o], rank[o], left=0.5, right=rank[o].max() + 0.5)
            else:
                key[lone] = s[at[lone]]
        out[i[at], leg] = np.searchsorted(np.sort(key), key, side="left")
    return items, out


def significant(mass: np.ndarray) -> np.ndarray:
    """Masses to DIGITS significant digits, so that sums taken in another order tie, however small the masses are."""
    unit = 10.0 ** (np.floor(np.log10(mass)) - DIGITS + 1)
    return np.round(mass / unit) * unit


def _significant(mass: Column) -> Column:
    unit = F.pow(F.lit(10.0), F.floor(F.log10(mass)) - DIGITS + 1)
    return F.rint(mass / unit) * unit


def _rank_groups(q: object, g: pd.DataFrame, damping: float, rounds: int) -> pd.DataFrame:
    items, places = _places(g)
    mass = significant(walk(places, damping, rounds))
    position = np.empty(len(items), np.int64)
    position[np.argsort(-mass, kind="stable")] = np.arange(1, len(items) + 1)  # items are in order already
    return pd.DataFrame({"q": q, "i": items, "mass": mass, "position": position})


def _positions(mass: DataFrame) -> DataFrame:
    """(q, i, mass, position) without a query in one task: slices of the order are numbered, each from where the ones before end."""
    up = Window.unboundedPreceding
    d = cut(mass.withColumn("mass", _significant(F.col("mass"))).repartitionByRange("q", F.desc("mass"), "i").withColumn("z", F.spark_partition_id()))
    per = d.groupBy("q", "z").agg(F.count("*").alias("c"))
    per = per.select("q", "z", F.coalesce(F.sum("c").over(Window.partitionBy("q").orderBy("z").rowsBetween(up, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("q", "z").orderBy(F.desc("mass"), "i"))
    return d.withColumn("at", at).join(per, ["q", "z"]).select("q", "i", "mass", (F.col("at") + F.col("before")).cast("int").alias("position"))


def _keys_hot(long: DataFrame) -> DataFrame:
    """(q, i, leg, key): the rank, or the place of a lone score between the ranked ones by the rule of _places.

    Distinct scores are numbered by slices of a range partitioning, and the nearest ranked scores below and above a slice are
    carried over from the slices' edges, so no leg is sorted in one task.
    """
    n, up = "rank is not null and score is not null", Window.unboundedPreceding
    long = cut(long.withColumn("rank", F.col("rank").cast("double")))
    lone = long.where("rank is null").select("q", "leg").distinct()
    both = long.where(n).groupBy("q", "leg").agg(F.count("*").alias("both"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.corr("rank", "score").alias("r"), F.max("rank").alias("most"))
    rule = cut(lone.join(both, ["q", "leg"], "left").withColumn("up", F.col("both").isNull() | (F.col("both") < 2) | (F.col("lo") == F.col("hi")) | (F.coalesce("r", F.lit(float("nan"))) <= 0)))
    some = long.where("score is not null").join(rule, ["q", "leg"]).withColumn("s", F.when(F.col("up"), -F.col("score")).otherwise(F.col("score")))
    some = some.groupBy("q", "leg", "s").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.first("most").alias("most"), F.first("both").alias("both"))
    some = cut(some.repartitionByRange("q", "leg", "s").withColumn("z", F.spark_partition_id()))
    known = F.when(F.col("first").isNotNull(), F.struct("s", "first", "last"))
    edge = some.groupBy("q", "leg", "z").agg(F.min(known).alias("low"), F.max(known).alias("high"))
    over = Window.partitionBy("q", "leg")
    edge = edge.select("q", "leg", "z", F.last("high", True).over(over.orderBy("z").rowsBetween(up, -1)).alias("before"), F.last("low", True).over(over.orderBy(F.desc("z")).rowsBetween(up, -1)).alias("after"))
    inside = Window.partitionBy("q", "leg", "z")
    some = some.join(edge, ["q", "leg", "z"])
    a = F.coalesce(F.last(known, True).over(inside.orderBy("s").rowsBetween(up, -1)), F.col("before"))
    b = F.coalesce(F.last(known, True).over(inside.orderBy(F.desc("s")).rowsBetween(up, -1)), F.col("after"))
    some = some.withColumn("a", a).withColumn("b", b)
    slope = (F.col("b.first") - F.col("a.last")) / (F.col("b.s") - F.col("a.s"))
    key = (
        F.when(F.col("both").isNull(), F.col("s")).when(F.col("last").isNotNull(), F.col("last")).when(F.col("a").isNull(), F.lit(0.5)).when(F.col("b").isNull(), F.col("most") + 0.5)
        .otherwise(slope * (F.col("s") - F.col("a.s")) + F.col("a.last"))
    )
    placed = some.select("q", "leg", "s", key.alias("key"))
    rest = long.where("rank is null").join(rule.select("q", "leg", "up"), ["q", "leg"]).withColumn("s", F.when(F.col("up"), -F.col("score")).otherwise(F.col("score")))
    rest = rest.join(placed, ["q", "leg", "s"]).select("q", "i", "leg", "key")
    return long.where("rank is not null").select("q", "i", "leg", F.col("rank").alias("key")).union(rest)


def _dense(keyed: DataFrame) -> DataFrame:
    """(q, i, leg, rank): the number of distinct keys of the leg below, so that buckets of it are even."""
    up = Window.unboundedPreceding
    d = cut(keyed.select("q", "leg", "key").distinct().repartitionByRange("q", "leg", "key").withColumn("z", F.spark_partition_id()))
    per = d.groupBy("q", "leg", "z").agg(F.count("*").alias("c"))
    per = per.select("q", "leg", "z", F.coalesce(F.sum("c").over(Window.partitionBy("q", "leg").orderBy("z").rowsBetween(up, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("q", "leg", "z").orderBy("key")) - 1
    d = d.withColumn("at", at).join(per, ["q", "leg", "z"])
    return keyed.join(d.select("q", "leg", "key", (F.col("at") + F.col("before")).cast("double").alias("rank")), ["q", "leg", "key"]).select("q", "i", "leg", "rank")


def _rank_hot(long: DataFrame, damping: float, rounds: int, bucket: int) -> DataFrame:
    """The same walk for queries of any size: prefix sums over rank buckets, whose totals are summed first."""
    odds = (1 - damping) / damping
    up, down = Window.unboundedPreceding, -1
    leg = Window.partitionBy("q", "leg")
    long = _dense(cut(_keys_hot(long))).withColumn("b", F.floor(F.col("rank") / bucket))
    fine = long.groupBy("q", "leg", "b", "rank").agg(F.count("*").alias("n"))
    coarse = fine.groupBy("q", "leg", "b").agg(F.sum("n").alias("nb")).withColumn("before", F.coalesce(F.sum("nb").over(leg.orderBy("b").rowsBetween(up, down)), F.lit(0)))
    fine = fine.withColumn("c", F.coalesce(F.sum("n").over(Window.partitionBy("q", "leg", "b").orderBy("rank").rowsBetween(up, down)), F.lit(0)))
    place = fine.join(coarse, ["q", "leg", "b"]).select("q", "leg", "b", "rank", (F.col("c") + F.col("before")).cast("double").alias("above"))
    seen = cut(long.join(place, ["q", "leg", "b", "rank"]).select("q", "i", "leg", "b", "rank", "above"))
    held = seen.groupBy("q", "leg").agg(F.count("*").alias("held")).groupBy("q").agg(F.sum("held").alias("held"), F.count("*").alias("legs"))
    size = seen.select("q", "i").distinct().groupBy("q").agg(F.count("*").cast("double").alias("n")).join(held, "q")
    full = seen.groupBy("q", "leg").agg(F.count("*").alias("m"))
    # what stands above an item over all legs: its places, and the whole of each leg that lacks it
    rate = seen.join(full, ["q", "leg"]).groupBy("q", "i").agg(F.sum(F.col("above") - F.col("m")).alias("a")).join(size, "q")
    rate = cut(rate.select("q", "i", "n", "legs", ((F.col("a") + F.col("held")) / F.col("legs") + odds * F.col("n")).alias("rate")))
    p = rate.select("q", "i", (1 / F.col("n")).alias("p"))
    for k in range(1, rounds + 1):
        flow = seen.join(p, ["q", "i"]).groupBy("q", "leg", "b", "rank").agg(F.sum("p").alias("m"))
        total = flow.groupBy("q", "leg", "b").agg(F.sum("m").alias("mb"))
        total = total.withColumn("after", F.coalesce(F.sum("mb").over(leg.orderBy(F.desc("b")).rowsBetween(up, down)), F.lit(0.0)))
        lacking = total.groupBy("q", "leg").agg((1 - F.sum("mb")).alias("lacking"))
        below = flow.withColumn("w", F.coalesce(F.sum("m").over(Window.partitionBy("q", "leg", "b").orderBy(F.desc("rank")).rowsBetween(up, down)), F.lit(0.0)))
        below = below.join(total.join(lacking, ["q", "leg"]), ["q", "leg", "b"]).select("q", "leg", "b", "rank", (F.col("w") + F.col("after") + F.col("lacking")).alias("w"))
        got = seen.join(below, ["q", "leg", "b", "rank"]).groupBy("q", "i").agg(F.sum("w").alias("w"))
        new = cut(got.join(rate, ["q", "i"]).select("q", "i", ((F.col("w") / F.col("legs") + odds) / F.col("rate")).alias("x")))
        norm = new.groupBy("q").agg(F.sum("x").alias("all"))
        before, p = p, new.join(norm, "q").select("q", "i", (F.col("x") / F.col("all")).alias("p"))
        if k % 10 == 0:
            moved = before.join(p.withColumnRenamed("p", "new"), ["q", "i"]).agg(F.max(F.abs(1 - F.col("p") / F.col("new")))).first()[0]
            if moved is None or moved < TOLERANCE:
                break
    return p.select("q", "i", F.col("p").alias("mass"))


def combined_ranking(df: DataFrame, query: str = "query_id", item: str = "chunk_id", ranks: str = "source_ranks", scores: str = "source_scores", damping: float = DAMPING, rounds: int = ROUNDS, task_rows: int = TASK_ROWS, bucket: int = BUCKET) -> DataFrame:
    """(query, item, mass, position): positions from 1 in order of mass, ties by item.

    Rows with a null query or item, and items that no leg places, have no row. Repeated rows count once. An empty table
    gives an empty result. Queries of more than task_rows rows take the distributed path: the same placement, walk and order.
    Masses are given to ten significant digits, and equal ones tie.
    """
    long = legs_long(df, query, item, ranks, scores)
    kinds = dict(long.dtypes)
    schema = T.StructType([T.StructField("q", long.schema["q"].dataType), T.StructField("i", long.schema["i"].dataType), T.StructField("mass", T.DoubleType()), T.StructField("position", T.IntegerType())])
    hot = df.groupBy(F.col(query).alias("q")).count().where((F.col("count") > task_rows) & F.col("q").isNotNull()).select("q", F.lit(True).alias("hot"))
    local = lambda key, g: _rank_groups(key[0], g, damping, rounds)
    if hot.isEmpty():
        out = long.groupBy("q").applyInPandas(local, schema)
    else:
        tagged = long.join(hot, "q", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        large = _positions(_rank_hot(tagged.where("hot").drop("hot"), damping, rounds, bucket)).withColumn("q", F.col("q").cast(kinds["q"]))
        out = tagged.where("not hot").drop("hot").groupBy("q").applyInPandas(local, schema).union(large)
    return out.select(F.col("q").alias(query), F.col("i").alias(item), "mass", "position")
