import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from civicspark.llm import mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 500)), max_size=60), st.integers(0, 10**6))
def test_flight_keeps_both_totals(units, seed):
    pi, x = np.array([u[0] for u in units]), np.array([u[1] for u in units])
    out = mixing.flight(pi, x, np.random.default_rng(seed))
    left = (out > 1e-9) & (out < 1 - 1e-9)
    assert left.sum() <= 2 and np.all((out >= 0) & (out <= 1))
    assert abs(out.sum() - pi.sum()) < 1e-5 and abs((out * x).sum() - (pi * x).sum()) < 1e-2
    assert set(mixing.land(out, np.random.default_rng(seed))) <= {0.0, 1.0}


def test_expectations_are_kept():
    pi, x = np.array([0.2, 0.5, 0.7, 0.3, 0.8]), np.array([3, 9, 4, 1, 7])
    got = np.mean([mixing.land(mixing.flight(pi, x, np.random.default_rng(s)), np.random.default_rng(s + 9)) for s in range(6000)], axis=0)
    assert np.allclose(got, pi, atol=0.03)


def docs(spark):
    rows = [(k, "big", "word " * (k % 37 + 1), 1) for k in range(900)] + [(2000 + k, "small", "word " * 20, 1) for k in range(10)] + [(5000, None, "x", 1), (5001, "other", "x", 1), (5002, "big", None, 1), (5003, "big", "", 1), (0, "big", "word ", 1)]
    return spark.createDataFrame(rows, "doc_id int, source string, text string, repeats int")


TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("none", 0.2, 4), (None, 0.1, 1)], TARGETS)
    for block in (8192, 64):
        uses, plan = mixing.mix(docs(spark), t, block=block)
        u = uses.collect()
        r = {x.source: x for x in mixing.report(uses, plan).collect()}
        assert sum(x.same for x in u) == 900 + 10 + 3 and all(0 <= x.repeats <= {"big": 2, "small": 3}[x.source] * x.same for x in u)
        assert abs(r["big"].actual_tokens - r["big"].target_tokens) < 0.01 * r["big"].target_tokens
        assert {s for s, x in r.items() if x.exhausted} == {"small", "none"} and r["small"].actual_tokens == 3 * r["small"].own_tokens and r["none"].n_docs == 0
        assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    again = {(x.id, x.n_tokens): x.repeats for x in mixing.mix(docs(spark), t, block=64)[0].collect()}
    assert again == {(x.id, x.n_tokens): x.repeats for x in u}


def test_empty(spark):
    t = spark.createDataFrame([("big", 1.0, 2)], TARGETS)
    uses, plan = mixing.mix(docs(spark).limit(0), t)
    assert uses.count() == 0
    (r,) = mixing.report(uses, plan).collect()
    assert r.actual_tokens == 0 and not r.exhausted and r.actual_share is None
