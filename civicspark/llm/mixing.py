"""Sources mixed to target weights by balanced sampling with the cube method.

A source's rate (target tokens over own tokens, at most max_repeats) is the expected number of uses of each of its
documents: its whole part is given to all, its fraction is an inclusion probability. The cube method moves these
probabilities through the null space of the balance constraints (documents and tokens) until all but two of them
are 0 or 1, so that the sample keeps both totals. It runs in blocks of bounded size; what a block leaves undecided
(two documents at most) meets the leftovers of other blocks in the next round, until one block per source is left,
whose last two documents are landed at random. A source with a third of all documents is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.tokens import count_table
from civicspark.session import cut

BLOCK = 8192
EPS = 1e-9


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but at most two are 0 or 1; their sum and their size-weighted sum are unchanged.

    Expectations are kept as well: each step is a fair move between two bounds.
    """
    pi = pi.astype(float).copy()
    live: list[int] = []
    todo = iter(np.flatnonzero((pi > EPS) & (pi < 1 - EPS)))
    p, x = pi.tolist(), size.astype(float).tolist()
    draw = rng.random(len(pi) + 4).tolist()
    k = 0
    while True:
        while len(live) < 3 and (nxt := next(todo, None)) is not None:
            live.append(int(nxt))
        if len(live) < 3:
            break
        a, b, c = live
        # the direction in which neither the number nor the size changes
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(live, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        step = up if draw[k % len(draw)] * (up + down) < down else -down
        k += 1
        for i, d in zip(live, u, strict=True):
            p[i] += step * d
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        live = [i for i in live if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The last two documents: the number is still kept where it can be, the size no longer."""
    pi = pi.copy()
    left = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    if len(left) == 2:
        a, b = left
        up, down = min(1 - pi[a], pi[b]), min(pi[a], 1 - pi[b])
        step = up if rng.random() * (up + down) < down else -down
        pi[a] += step
        pi[b] -= step
        left = [i for i in left if EPS < pi[i] < 1 - EPS]
    for i in left:
        pi[i] = float(rng.random() < pi[i])
    return np.round(pi)


def _seed(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("|".join(map(str, parts)))


def _fly(units: DataFrame, key: str, kind: str, last: bool, seed: int) -> DataFrame:
    def run(block: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(_seed(seed, *block))
        g = g.sort_values("mark", ignore_index=True)
        pi = flight(g["pi"].to_numpy(), g["n_tokens"].to_numpy(), rng)
        g["pi"] = land(pi, rng) if last else pi
        return g[["source", "id", "n_tokens", "mark", "pi"]]

    return units.groupBy("source", "block").applyInPandas(run, f"source string, id {kind}, n_tokens bigint, mark bigint, pi double")


def source_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, own_tokens, target_tokens, rate) per row of targets; sources without documents have rate 0."""
    own = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("own_tokens"))
    plan = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(own, "source", "left").fillna(0, ["n_docs", "own_tokens"])
    plan = cut(plan)
    total = plan.agg(F.sum("own_tokens")).first()[0] or 0
    plan = plan.withColumn("target_tokens", F.col("target_share") * F.lit(float(total)))
    rate = F.when(F.col("own_tokens") > 0, F.least(F.col("target_tokens") / F.col("own_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return plan.select("source", "target_share", "max_repeats", "n_docs", "own_tokens", "target_tokens", rate.alias("rate"))


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, block: int = BLOCK, **tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(uses, plan). uses: (id, source, n_tokens, repeats) for every document of a listed source, repeats from 0 to max_repeats.

    The total size aimed at is that of all documents of the listed sources; a source that max_repeats keeps below its
    target is used in full and not made up for by others. Sizes are tokens; null and empty texts have none (they follow the rate
    of their source). Documents of other sources or without a source are left out; targets with a null source, share or
    cap are ignored; a source listed twice counts with its largest share and cap. The same seed gives the same mix.
    """
    targets = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null")
    # a table of sources is small by nature; the hint is left to the optimiser's own check of its size
    listed = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).join(targets.select("source").distinct(), "source", "left_semi")
    kind = dict(listed.dtypes)["id"]
    sizes = cut(count_table(listed.select("id", "source", "text"), "text", "n_tokens", **tokenizer))
    plan = cut(source_plan(sizes, targets))
    most = plan.agg(F.max("n_docs")).first()[0] or 0
    rates = plan.select("source", F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("frac"))
    every = sizes.join(rates, "source")
    mark = F.xxhash64("id", F.lit(seed))
    units = every.where(F.col("frac") > EPS).select("source", "id", "n_tokens", mark.alias("mark"), F.col("frac").alias("pi"))
    settled = None
    blocks = max(1, -(-most // block))
    while True:
        # blocks of a small source may be few documents; they only leave more to the next round
        flown = cut(_fly(units.withColumn("block", F.pmod("mark", F.lit(blocks))), "block", kind, blocks == 1, seed))
        done = flown.where((F.col("pi") < EPS) | (F.col("pi") > 1 - EPS))
        settled = done if settled is None else settled.union(done)
        if blocks == 1:
            break
        units = flown.where((F.col("pi") >= EPS) & (F.col("pi") <= 1 - EPS))
        blocks = -(-2 * blocks // block) if blocks > 1 else 1
    chosen = settled.where("pi > 0.5").groupBy("source", "id", "n_tokens").agg(F.count("*").alias("extra"))
    # rows repeated for an id are told apart by their number only: extras are spread over them
    n_same = every.groupBy("source", "id", "n_tokens", "base").agg(F.count("*").alias("same"))
    uses = n_same.join(chosen, ["source", "id", "n_tokens"], "left")
    return uses.select("id", "source", "n_tokens", (F.col("base") * F.col("same") + F.coalesce("extra", F.lit(0))).cast("int").alias("repeats"), "same"), plan


def report(uses: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, target_tokens, actual_tokens, own_tokens, n_docs, max_repeats, exhausted).

    exhausted: every document is used max_repeats times (or there is none) and the target is not reached.
    """
    got = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.sum("repeats").alias("uses"), F.min(F.col("repeats") / F.col("same")).alias("least"))
    r = cut(plan.join(got, "source", "left").fillna(0, ["actual_tokens", "uses"]))
    mixed = r.agg(F.sum("actual_tokens")).first()[0] or 0
    full = F.coalesce(F.col("least") >= F.col("max_repeats"), F.lit(True)) & (F.col("target_tokens") > F.col("actual_tokens") * (1 + 1e-12))
    return r.select(
        "source", "target_share", F.try_divide("actual_tokens", F.lit(mixed)).alias("actual_share"), "target_tokens", "actual_tokens", "own_tokens", "n_docs", "max_repeats", "uses", full.alias("exhausted")
    )
