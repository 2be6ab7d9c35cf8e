"""One shard that holds most texts: bounded tasks, whole results, recall near the threshold."""

import random

import numpy as np
from pyspark.sql import functions as F

from civicspark.llm import neardup
from tests.llm.test_neardup import VOCAB, brute, family


def test_hot_shards_are_split_on_both_sides(spark):
    rng = random.Random(31)
    texts = family(rng, 120) + [t for _ in range(20) for t in family(rng, 2)] + [" ".join(rng.choice(VOCAB) for _ in range(90)) for _ in range(40)]
    df = spark.createDataFrame([(f"id{k:03d}", t) for k, t in enumerate(texts)], "id string, text string")
    # every text in one shard of band 0, as if all shared its minima
    reps = neardup.fingerprints(df, "id", "text", "t").withColumn("bands", F.array(F.lit(7).cast("bigint"))).cache()
    hot = neardup.hot_shards(reps, 20, 1)
    assert [r.parts for r in hot.collect()] == [10]
    rows = reps.select(F.explode("bands").alias("band"), "node", "sketch", F.when(F.col("id") < "id120", 1).otherwise(F.col("node")).cast("bigint").alias("grp"))
    n = rows.count()
    for cells in (neardup._cells(rows, hot), neardup._outside(rows, hot, 20)):
        sizes = cells.groupBy("cell", "role").count().collect()
        assert max(r["count"] for r in sizes) <= 45  # about 20 in a tree and 20 queries
    assert neardup._cells(rows, hot).count() < 3 * n  # grows with the rows
    assert neardup._outside(rows.where("grp = 1"), hot, 20).count() == 0  # a shard that copies have filled has no more to do


def test_groups_with_hot_shards_equal_brute_force(spark):
    rng = random.Random(8)
    texts = {f"id{k:03d}": t for k, t in enumerate(family(rng, 60) + [t for _ in range(15) for t in family(rng, 2)])}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = neardup.group_pairs(neardup.edited_copies({"t": (df, "id", "text")}, shard_rows=8, sample=1)).collect()
    assert {(r.id_a, r.id_b) for r in got} == brute(texts)


def recall(similarity, pairs=3000, n=400):
    """Share of pairs of about this similarity that share a band and lie within the radius."""
    rng = np.random.default_rng(4)
    same = round(2 * n * similarity / (1 + similarity))
    runs = []
    for _ in range(pairs):
        x = rng.integers(0, 1 << 63, 2 * n - same, dtype=np.uint64) << np.uint64(1)
        runs += [x[:n], x[n - same :]]
    bands, sketch = neardup.signatures(runs)
    met = (bands[::2] == bands[1::2]).any(1)
    near = np.bitwise_count(sketch[::2].view(np.uint64) ^ sketch[1::2].view(np.uint64)) <= neardup.RADIUS
    return (met & near).mean()


def test_recall_at_the_threshold():
    assert recall(0.51) >= 0.93 and recall(0.6) >= 0.99
