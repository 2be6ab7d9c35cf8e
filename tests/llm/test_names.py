from civicspark.llm import names as N


def test_measures():
    assert round(N.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(N.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert N.edits("abc", "acb") == 1 and N.edits("abc", "abc") == 0 and N.edits("abcdef", "xyz") == 3
    assert [N.soundex(x) for x in ("robert", "rupert", "ashcraft", "tymczak")] == ["r163", "r163", "a261", "t522"]


def same(a, b, kind="person"):
    return N.SAME[kind](N.READ[kind](a), N.READ[kind](b))


def test_persons():
    for b in ("Doe-Smith, Elizabeth", "Liz Doe-Smith", "Doe-Smith Elizabeth", "Dr. Elizabeth Doe-Smith", "Elizabeth  Doe-Smith (vice chair)", "ELIZABETH DOE-SMITH", "Elizabth Doe-Smith", 'Elizabeth "Betty" Doe-Smith', "Elizabeth Q. Doe-Smith"):
        assert same("Elizabeth Doe-Smith", b) == "strong", b
    for b in ("E. Doe-Smith", "Doe-Smith, E.", "Trustee Doe-Smith"):
        assert same("Elizabeth Doe-Smith", b) == "weak", b
    for b in ("Margaret Doe-Smith", "Elizabeth Jones", "M. Doe-Smith"):
        assert same("Elizabeth Doe-Smith", b) is None, b
    assert same("Björn Thelander", "Bjorn Thelander") == "strong"
    assert N.read_person("Speaker 1 (2024-01-01)") is None and N.read_person("SPEAKER_04") is None and N.read_person("...") is None


def test_committees():
    full = "Athletics and Wellness Committee"
    for b in ("The Athletics & Wellness Committee", "Wellness and Athletics Committee", "Athletics/Wellness Cmte", "ATHLETICS AND WELLNESS COMMITTEE", "Athlectics and Wellness Committee", "Athletics and Wellness Committee - regular"):
        assert same(full, b, "committee") == "strong", b
    assert same(full, "ATH/WEL Cmte", "committee") == "weak"
    assert same("Equity and Technology Task Force", "EQU/TEC TF", "committee") == "weak" and same("Equity and Technology Task Force", "Equity/Technology Taskforce", "committee") == "strong"
    for b in ("Athletics and Wellness Council", "Athletics and Heritage Committee", "Athletics and Wellness Subcommittee"):
        assert same(full, b, "committee") is None, b


def clusters(spark, rows, **more):
    df = spark.createDataFrame(rows, "tenant_id string, kind string, name string, entity string")
    out: dict = {}
    for r in N.linked_names(df, **more).collect():
        out.setdefault((r.tenant_id, r.kind, r.entity), set()).add(r.name)
    return sorted((k[0], sorted(v)) for k, v in out.items())


ROWS = [("t", "person", n, "x") for n in ("Ann Stonefield", "A. Stonefield", "Member Stonefield", "Anne Q. Brook", "Brook, A.", "Alan Brook", "Stonefeild, Ann", "Speaker 2", None, "  ", "Ann Stonefield")] + [("u", "person", "Ann Stonefield", "x"), (None, "person", "Ann Stonefield", "x")]


def test_clusters(spark):
    want = [("t", ["A. Stonefield", "Ann Stonefield", "Member Stonefield", "Stonefeild, Ann"]), ("t", ["Alan Brook"]), ("t", ["Anne Q. Brook"]), ("t", ["Brook, A."]), ("u", ["Ann Stonefield"])]
    assert clusters(spark, ROWS) == want  # "Brook, A." fits two persons and stays alone
    assert clusters(spark, ROWS, block_rows=2) == want  # split blocks
    assert clusters(spark, []) == []
