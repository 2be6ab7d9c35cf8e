from civicspark.llm import names as N
from tests.llm.test_names import clusters

GIVEN = ("Ann", "Bob", "Carl", "Dora", "Eric", "Fay", "Gus", "Hope")


def test_a_slip_in_a_short_given_name_is_met_in_split_blocks(spark):
    assert N.SAME["person"](N.read_person("Mark Johnson"), N.read_person("Nark Johnson")) == "strong"
    rows = [("t", "person", n, "x") for n in ("Mark Johnson", "Nark Johnson", *(f"{g} Johnson" for g in GIVEN))]
    rows += [("t", "committee", n, "x") for n in ("Wellness Committee", "Welness Committee", "Welfare Committee", "Well Board")]
    want = clusters(spark, rows)
    assert ("t", ["Mark Johnson", "Nark Johnson"]) in want
    for block_rows in (1, 3):
        assert clusters(spark, rows, block_rows=block_rows) == want
