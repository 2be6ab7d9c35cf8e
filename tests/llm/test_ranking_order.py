"""One order at every size: missing ranks and NaN on both paths, and masses of large queries that still tell items apart."""

import math
import random

import numpy as np

from civicspark.llm import ranking
from tests.llm.test_ranking import frame, order


def test_equal_order_on_both_paths(spark):
    random.seed(12)
    rows = []
    for q in (1, 2):
        for i in range(60):
            ranks = {leg: random.randint(1, 30) for leg in "ab" if random.random() < 0.6}
            scores = {leg: random.choice([math.nan, None, random.random()]) for leg in "abc" if random.random() < 0.8}
            rows.append((q, f"c{i:02d}", ranks, scores))
    a = order(ranking.combined_ranking(frame(spark, rows), rounds=10))
    b = order(ranking.combined_ranking(frame(spark, rows), rounds=10, task_rows=5, bucket=7))
    assert a == b and len(a) > 100


def test_masses_of_large_queries_stay_distinct():
    rng = np.random.default_rng(3)
    n = 100_000
    above = np.stack([rng.permutation(n) for _ in range(3)], 1).astype(float)
    mass = ranking.walk(above)
    assert len(np.unique(ranking.significant(mass))) > 0.999 * n
    same = ranking.walk(np.array([[0.0, 1.0], [1.0, 0.0], [2.0, 2.0]]))
    assert len(np.unique(ranking.significant(same))) == 2
