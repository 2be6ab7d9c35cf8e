import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from civicspark.llm import repetition as R

UNITS = st.lists(st.sampled_from("alpha be gamma de epsilon zeta eta th iota kappa".split()), max_size=60)


@settings(max_examples=300, deadline=None)
@given(UNITS)
def test_rules_are_bounds(u):
    x = R.repeated_share(u)
    assert 0 <= x <= 1
    for name, rule in R.RULES.items():
        assert rule(u) >= x - 1e-9, name


def test_shares():
    s = "The committee moved to approve the annual budget of 2024. "
    other = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) + ". "
    assert R.repeated_share(R.units(other)) == 0
    assert R.repeated_share(R.units((s + other) + s.upper().replace("2024", "17"))) == pytest.approx(46 / (46 * 2 + 60 * 6), abs=0.02)
    assert R.repeated_share(R.units(s * 10)) == pytest.approx(0.9)
    assert R.repeated_share(R.units("spam " * 50)) > 0.9
    assert R.repeated_share(R.units("会议记录批准了合同。" * 8)) > 0.8
    assert R.repeated_share([]) == 0


def test_table(spark):
    s = "One two three four five six. "
    rows = [(1, s * 9, 0.5), (2, "nothing here repeats at all", 0.5), (3, None, None), (4, "", 0.1), (5, " .,! ", 0.1), (6, s * 20_000, 0.2), (1, s * 9, 0.5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, score double")
    for order in (None, [], ["triples", "units", "pairs"], ["units"]):
        got = R.repetition(df, order=order).collect()
        assert len(got) == 7 and sorted(r.doc_id for r in got if r.repetitive) == [1, 1, 6]
        assert all(r.decided_by == "empty" for r in got if r.doc_id in (3, 4, 5))
    assert R.repetition(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.repetition(df.withColumnRenamed("score", "repetitive"))
