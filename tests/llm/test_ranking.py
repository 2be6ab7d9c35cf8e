import math
import random

import numpy as np

from civicspark.llm import ranking


def dense(above, damping):
    """The walk as a matrix: pick a leg, draw an item, jump if the leg ranks it higher; restart at a small rate."""
    n, legs = above.shape
    rate = np.zeros((n, n))
    for k in range(legs):
        for i in range(n):
            for j in range(n):
                if above[j, k] < above[i, k]:
                    rate[i, j] += 1 / legs
    rate += (1 - damping) / damping
    q = rate - np.diag(rate.sum(1))
    a = np.vstack((q.T, np.ones(n)))
    return np.linalg.lstsq(a, np.r_[np.zeros(n), 1], rcond=None)[0]


def test_walk_is_stationary():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n, legs = rng.integers(2, 15), rng.integers(1, 5)
        above = np.array([[int(x) for x in rng.integers(0, n, legs)] for _ in range(n)])
        above = np.stack([np.searchsorted(np.sort(above[:, k]), above[:, k], side="left") for k in range(legs)], 1)
        got = ranking.walk(above, rounds=2000)
        assert np.allclose(got, dense(above, ranking.DAMPING), atol=1e-8)


SCHEMA = "query_id bigint, chunk_id string, rrf_score double, source_ranks map<string,int>, source_scores map<string,double>, mass string, position int"


def frame(spark, rows):
    return spark.createDataFrame([(q, c, None, r, s, "x", 1) for q, c, r, s in rows], SCHEMA)


def order(df):
    return [r.chunk_id for r in sorted(df.collect(), key=lambda r: (r.query_id, r.position))]


def test_no_scale_dominates(spark):
    base = [("a", 2, 1), ("b", 1, 2), ("c", 3, 3), ("d", 4, 4)]
    rows = [(1, c, {"x": x, "y": y}, {"x": 1e9 / x, "y": 1e-9 / y}) for c, x, y in base] + [(1, "lone", {"x": 5}, {"x": 1.0})]
    got = order(ranking.combined_ranking(frame(spark, rows)))
    assert set(got[:2]) == {"a", "b"} and got[2:4] == ["c", "d"]
    lone = [(1, "top", {"x": 1}, {"x": 1e12})] + [(1, f"k{i}", {"x": i + 2, "y": i + 1}, None) for i in range(8)]
    assert order(ranking.combined_ranking(frame(spark, lone)))[0] == "k0"


def test_odd_rows(spark):
    rows = [
        (1, "a", {"x": 1}, {"x": None}), (1, "a", {"x": 1}, {"x": None}), (1, "b", None, {"x": math.nan}), (1, "c", None, {"y": 3.0}), (1, "d", {"x": 2}, None), (1, None, {"x": 1}, None), (None, "z", {"x": 1}, None),
        (2, "t2", {"x": 1}, None), (2, "t1", {"x": 1}, None),
    ]
    got = ranking.combined_ranking(frame(spark, rows)).collect()
    assert sorted((r.query_id, r.chunk_id) for r in got) == [(1, "a"), (1, "c"), (1, "d"), (2, "t1"), (2, "t2")]
    two = {r.chunk_id: r for r in got if r.query_id == 2}
    assert two["t1"].mass == two["t2"].mass and two["t1"].position == 1
    assert ranking.combined_ranking(frame(spark, [])).count() == 0


def test_large_queries_take_the_same_walk(spark):
    random.seed(5)
    rows = [(q, f"c{i}", {leg: random.randint(1, 25) for leg in "xyz" if random.random() < 0.7}, None) for q in (1, 2) for i in range(30)]
    a = {(r.query_id, r.chunk_id): r.mass for r in ranking.combined_ranking(frame(spark, rows), rounds=4).collect()}
    b = {(r.query_id, r.chunk_id): r.mass for r in ranking.combined_ranking(frame(spark, rows), rounds=4, task_rows=5, bucket=7).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
