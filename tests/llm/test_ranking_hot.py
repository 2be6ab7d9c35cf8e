import math
import random

from civicspark.llm import ranking
from tests.llm.test_ranking import frame


def test_scores_without_ranks_place_alike_on_both_paths(spark):
    random.seed(8)
    rows = []
    for q in (1, 2, 3):
        for i in range(40):
            ranks, scores = {}, {}
            for leg, sign in (("up", -1), ("down", 1), ("flat", 0), ("ranked", 1)):
                r = random.randint(1, 12)
                if leg == "ranked" or random.random() < 0.5:
                    ranks[leg] = r
                if leg != "ranked" and random.random() < 0.8:
                    scores[leg] = sign * r + random.choice([0.0, 0.0, 0.25, -3.0, 20.0])
            scores["lone"] = float(random.randint(0, 30))  # no rank in the whole leg
            rows.append((q, f"c{i}", ranks, scores))
    rows.append((4, "small", {"up": 1}, {"lone": 2.0}))
    a = {(r.query_id, r.chunk_id): r.mass for r in ranking.combined_ranking(frame(spark, rows), rounds=4).collect()}
    b = {(r.query_id, r.chunk_id): r.mass for r in ranking.combined_ranking(frame(spark, rows), rounds=4, task_rows=5, bucket=7).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
    assert len({m for (q, _), m in b.items() if q == 1}) > 30


def test_the_path_of_a_query_is_its_own(spark, monkeypatch):
    rows = [(1, f"c{i}", {leg: i + 1 for leg in "xyz"}, None) for i in range(20)] + [(2, f"c{i}", {leg: i + 1 for leg in "xyz"}, None) for i in range(8)]
    seen = []
    keep = ranking._rank_hot
    monkeypatch.setattr(ranking, "_rank_hot", lambda long, *more: seen.append({r.q for r in long.select("q").distinct().collect()}) or keep(long, *more))
    ranking.combined_ranking(frame(spark, rows), rounds=2, task_rows=10).collect()
    assert seen == [{1}]  # 8 rows with 3 legs each are fewer than 10
