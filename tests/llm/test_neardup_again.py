"""False hits of a shard keep no true link back: texts with common boilerplate against brute force over all that meet."""

import random

from civicspark.llm import neardup

HASHER = neardup.Hasher()


def boilerplate(rng):
    common = [f"b{k}" for k in range(84)]
    texts = []
    for f in range(60):
        own = [f"f{f}w{k}" for k in range(60)]
        for _ in range(2):
            t = list(own)
            for _ in range(9):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(common + t))
    return {f"id{k:03d}": t for k, t in enumerate(texts)}


def test_all_that_meet_are_joined(spark):
    texts = boilerplate(random.Random(5))
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    prints = {r.id: r for r in neardup.fingerprints(df, "id", "text", "t").collect()}
    ids = sorted(texts)
    near = [(a, b) for a in ids for b in ids if a < b and set(prints[a].bands) & set(prints[b].bands) and ((prints[a].sketch ^ prints[b].sketch) & (2**64 - 1)).bit_count() <= neardup.RADIUS]
    true = {(a, b) for a, b in near if neardup.jaccard(texts[a], texts[b], HASHER) > neardup.THRESHOLD}
    assert len(true) > 20 and len(near) > 10 * len(true)
    root = {i: i for i in ids}
    for a, b in true:
        old, new = root[a], root[b]
        root = {i: new if r == old else r for i, r in root.items()}
    want = {(a, b) for a in ids for b in ids if a < b and root[a] == root[b]}
    for more in ({}, {"shard_rows": 20, "sample": 1}):
        got = neardup.group_pairs(neardup.edited_copies({"t": (df, "id", "text")}, **more)).collect()
        assert {(r.id_a, r.id_b) for r in got} == want
