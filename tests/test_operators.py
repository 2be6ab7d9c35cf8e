import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from civicspark import plugins
from civicspark.functions import text as X
from civicspark.operators import chunking, relational, retrieval, sqlguard, stats
from civicspark.streaming import activity


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


def test_scalars(spark):
    assert one(spark, "20240230", X.loose_date) is None and one(spark, " 2024-02-29 ", X.loose_date) == datetime.date(2024, 2, 29)
    assert one(spark, "x_1_31_24.mp3", X.file_date) == datetime.date(2024, 1, 31) and one(spark, "x_13_1_24.mp3", X.file_date) is None
    assert one(spark, "a05FEB2021b", X.month_name_date) == datetime.date(2021, 2, 5)
    assert [one(spark, v, X.suppressed_number) for v in ("<3.6%", "N<20", "1,234", "Suppress: N<10", None, "")] == [3.6, 0.0, 1234.0, 0.0, 0.0, 0.0]
    assert one(spark, "o'neil-smith  mary", X.title_name) == "O'Neil-Smith Mary" and one(spark, "abc", X.title_name) is None
    assert one(spark, "--Héllo, World!--", X.slug) == "h-llo-world"
    assert one(spark, "<p>a</p><script>x</script> &amp;  b", X.html_text) == "a & b"
    assert one(spark, "javascript:x", X.safe_url) is None and one(spark, "HTTPS://x", X.safe_url) == "HTTPS://x"
    assert [one(spark, v, X.clock, "double") for v in (0.0, 61.9, 3661.0)] == ["0:00", "1:01", "1:01:01"]
    assert one(spark, "```json\n{}\n```", X.fenced_json) == "{}" and one(spark, "a {x} b {y}", X.last_json_block) == "{y}"
    assert one(spark, -1000.0, X.sigmoid, "double") == 0.0


def test_page_classes_at_their_bounds(spark):
    words = "abc " * 40
    assert one(spark, words, lambda c: X.page_class(c, F.lit(1000.0))) == "TEXT_RICH"
    assert one(spark, words, lambda c: X.page_class(c, F.lit(1e9))) == "TEXT_SPARSE"
    assert one(spark, "x" * 200, lambda c: X.page_class(c, F.lit(1000.0))) == "TEXT_SPARSE"
    assert one(spark, "123456789", lambda c: X.page_class(c, F.lit(1000.0))) == "IMAGE_ONLY"
    assert one(spark, None, lambda c: X.page_class(c, F.lit(0.0))) == "IMAGE_ONLY"


def test_sentence_packer():
    text = "One two three four. " * 60
    got = chunking.pack_sentences(text, 20, 5, 1)
    assert all(n == len(c.split()) for c, n in got) and all(c.endswith(".") for c, _ in got)
    assert all(b[0].startswith("One two three four.") for b in got) and len(got) > 10
    long = "w " * 30 + "end. short one."
    got = chunking.pack_sentences(long, 20, 5, 1)
    assert got[0][1] == 31 and got[1] == ("short one.", 2)  # no overlap after an oversized sentence
    assert chunking.pack_sentences(None) == [] and chunking.pack_sentences("  ") == []
    assert chunking.pack_sentences("tiny.") == [("tiny.", 1)]
    assert chunking.pack_sentences("a b. c d. e f. g h.", 4, 2, 100) == [("a b. c d. e f. g h.", 8)]
    six = "A b c. D e f. G h i. J k l. M n o. P q r."
    assert [c for c, _ in chunking.pack_sentences(six, 7, 3, 1)] == ["A b c. D e f.", "D e f. G h i.", "G h i. J k l.", "J k l. M n o.", "M n o. P q r."]


def test_other_packers():
    assert chunking.pack_paragraphs("") == [] and chunking.pack_paragraphs("a\n\nb") == ["a\n\nb"]
    got = chunking.pack_paragraphs("x" * 900 + "\n\n" + "y" * 900, 1000, 100)
    assert got[0] == "x" * 900 and got[1] == "x" * 100 + "\n\n" + "y" * 900
    rows = [("A", 0.0, "w " * 400), ("B", 1.0, "short"), ("B", 2.0, "w " * 149)]
    got = [c for (c,) in chunking.pack_words(rows, 150)]
    assert [len(c.split()) - 1 for c in got[:3]] == [150, 150, 100] and got[3].count("\n") == 1
    got = list(chunking.pack_speaker([("A", 0.0, "a b."), ("A", 1.0, "c."), ("B", 2.0, ""), ("A", 3.0, "d")], 150))
    assert got == [("a b. c.", "A", 0.0), ("d", "A", 3.0)]
    got = list(chunking.pack_speaker([("A", 0.0, "one two three. " * 100)], 30))
    assert all(len(c[0].split()) <= 30 for c in got) and sum(len(c[0].split()) for c in got) == 300
    lines = [("l %d " % k + "w " * 40, "AB"[k % 2], float(k), k + 1.0) for k in range(6)]
    got = list(chunking.pack_lines(lines, 100, 10))
    assert got[1][0].split("\n")[0] == got[0][0].split("\n")[-1] and got[1][3] == 2.0 and got[0][2] == ["A", "B"]


def test_interval_and_range_joins(spark):
    roster = spark.createDataFrame([("2020-01-01", "2020-06-30", "a", 1), ("2020-06-01", "2020-12-31", "b", 2)], "s string, e string, n string, priority int").select(F.to_date("s").alias("start"), F.to_date("e").alias("end"), "n", "priority")
    d = spark.createDataFrame([("2020-06-15",), ("2020-07-01",), ("2025-01-01",), ("2020-06-15",)], "x string").select(F.to_date("x").alias("day"))
    assert sorted((str(r.day), r.n) for r in relational.by_interval(d, "day", roster).collect()) == [("2020-06-15", "a"), ("2020-06-15", "a"), ("2020-07-01", "b"), ("2025-01-01", "b")]
    random.seed(1)
    a = [(k % 3, random.uniform(0, 500)) for k in range(60)]
    b = [(k % 3, random.uniform(0, 500)) for k in range(200)]
    got = relational.range_join(spark.createDataFrame(a, "g int, t double"), spark.createDataFrame(b, "g int, u double"), ["g"], "u", F.col("t") - 5, F.col("t") + 30, 35.0).count()
    assert got == sum(x == y and t - 5 <= u <= t + 30 for x, t in a for y, u in b)
    with pytest.raises(ValueError):
        relational.tenant(d, "")


def test_statistics(spark):
    # published two-sided values of Student's t
    assert math.isclose(stats.student_p_value(2.228, 10), 0.05, abs_tol=1e-4) and math.isclose(stats.student_p_value(12.706, 1), 0.05, abs_tol=1e-4) and math.isclose(stats.student_p_value(1.96, 1e6), 0.05, abs_tol=1e-3)
    assert stats.betainc(2, 3, 0.5) == pytest.approx(0.6875)
    rows = [("g", 1, v) for v in (1.0, 2.0, 3.0, 4.0)] + [("g", 0, v) for v in (2.0, 4.0, 6.0, 8.0)] + [("h", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, a int, v double")
    r = {x.k: x for x in stats.welch(df, ["k"], "v", F.col("a") == 1).collect()}
    assert r["g"].t == pytest.approx(-1.7320508, 1e-6) and r["g"].df == pytest.approx(4.4117647, 1e-6) and r["g"].p == pytest.approx(0.1513, abs=1e-3) and r["h"].t is None
    u = {x.k: x for x in stats.mann_whitney(df, ["k"], "v", F.col("a") == 1).collect()}
    assert u["g"].u1 == sum((x > y) + (x == y) / 2 for x in (1, 2, 3, 4) for y in (2, 4, 6, 8))
    p = spark.createDataFrame([("a", 1, 0.001), ("a", 2, 0.03), ("a", 3, 0.02), ("a", 4, 0.04)], "g string, i int, p double")
    assert {x.i: x.rejected for x in stats.holm(p, ["g"], "p").collect()} == {1: True, 3: False, 2: False, 4: False}
    assert {x.i: x.rejected for x in stats.holm(p, ["g"], "p", compat=True).collect()} == {1: True, 3: False, 2: False, 4: True}
    t = stats.trend(spark.createDataFrame([("a", float(k), 2.0 * k + (k % 2) * 0.1) for k in range(10)] + [("b", 1.0, 1.0)], "g string, x double, y double"), ["g"], "x", "y").collect()
    d = {x.g: x for x in t}
    assert d["a"].direction == "increasing" and d["a"].p < 1e-6 and d["b"].direction == "stable"
    few = spark.createDataFrame([("x", 1), ("y", 2), ("T", 9)], "name string, n int")
    assert sorted(r.name for r in stats.peers(few, "name", "n", "t").collect()) == ["x", "y"]


def test_retrieval(spark):
    docs = spark.createDataFrame([("a", "red fox red", None), ("b", "the red big fox", None), ("c", "fox", None), ("d", None, None), ("e", "", None)], "k string, t string, d date")
    post = retrieval.postings(docs, "k", "t")
    q = spark.createDataFrame([(1, "red fox"), (2, "the"), (3, "red wolf")], "query_id int, text string")
    assert {(r.query_id, r.k, r.tf) for r in retrieval.match_all(post, q, "k").collect()} == {(1, "a", 3), (1, "b", 2)}
    assert {(r.query_id, r.k, r.hits) for r in retrieval.match_phrase(post, q, "k").collect()} == {(1, "a", 1)}
    cd = {r.k: r.score for r in retrieval.cover_density(post, q, "k").collect()}
    assert cd["a"] == pytest.approx(0.1 / 2 + 0.1 / 2) and cd["b"] == pytest.approx(0.1 / 3)
    assert one(spark, datetime.date(2024, 1, 1), lambda c: retrieval.recency(c, datetime.date(2024, 12, 31)), "date") == pytest.approx(0.5)
    assert one(spark, None, lambda c: retrieval.recency(c, datetime.date(2024, 1, 1)), "date") == 0.5
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [1.0])], "vec_id int, embedding array<float>")
    got = retrieval.knn(v, v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), 5).collect()
    assert sorted((r.vec_id, r.score) for r in got) == [(1, 1.0), (2, 0.0)]


def test_sql_guard(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("ok_view")
    for good in ("select * from ok_view", "with x as (select a from ok_view) select count(*) from x where a in (select a from ok_view)", "select ';' as s from ok_view -- fine"):
        sqlguard.check(spark, good, {"ok_view"})
    for bad in ("drop table ok_view", "select * from other", "insert into ok_view values (1)", "select 1; select 2", "select (select max(b) from secret) from ok_view", "create view v as select 1", "set x=1", "select reflect('java.lang.System', 'exit', 1)", "delete from ok_view", "select * from parquet.`/etc`", "show tables", "nonsense"):
        with pytest.raises(sqlguard.Refused):
            sqlguard.check(spark, bad, {"ok_view"})
    assert sqlguard.run(spark, "select a from ok_view", {"ok_view"}).first()[0] == '{"a":1}'


def test_plugins(spark):
    assert plugins.word_error_rate("a b c d", "a x c") == 0.5 and plugins.word_error_rate("", "") == 0 and plugins.word_error_rate("", "x") == 1
    assert plugins.word_edit_rate("a b c d", "a x c") == 0.5 and plugins.word_edit_rate("kitten sat", "sat") == 0.5
    df = spark.createDataFrame([(1, "Hello, there!", "hello there"), (2, None, "x")], "k int, a string, b string")
    assert [r[0] for r in df.orderBy("k").select(plugins.wer(F.col("a"), F.col("b"))).collect()] == [0.0, None]
    e = plugins.embed(df, "k", "a").collect()
    assert len(e[0].embedding) == 64 and sum(x * x for x in e[0].embedding) == pytest.approx(1, 1e-3)
    assert one(spark, "Then Mary Ann Stone met JOHN Doe there", plugins.person_names) == ["Then Mary Ann", "John Doe"]
    assert plugins.with_fallback(lambda p: 1 / 0, lambda p: "f")("x") == "f"


def test_reports_on_odd_tables(spark):
    from civicspark.operators import reports

    df = spark.createDataFrame([("2022", "District", "All Grades", "10", 1), ("2022", "District", "All Grades", "99", 2), ("2023", "District", "All Grades", "N<20", 3), ("2023", "District", "Kindergarten", "5", 4), (None, None, None, None, 5)], "schoolyear string, organizationlevel string, gradelevel string, all_students string, pos int")
    got = [(r.section, r.year, r.label, r.value) for r in reports.REPORTS["enrollment"].build(df, "pos").collect() if r.section in ("trend", "grades")]
    assert sorted(got, key=str) == [("grades", "2023", "Kindergarten", 5.0), ("trend", "2022", "", 10.0), ("trend", "2023", "", None)]
    for r in reports.REPORTS.values():
        assert r.build(df, "pos").count() >= 0 and r.build(df.limit(0), "pos").count() == 0
    change = [("2020-21", "100", "10"), ("2021-22", "120", "14"), ("2023-24", "150", "9")]
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(change)], "school_year_code string, total_ppe string, federal_ppe string, pos int")
    (c,) = [r for r in reports.REPORTS["expenditure"].build(e, "pos").collect() if r.section == "change"]
    assert (c.value, c.part, c.whole, c.note) == (50.0, 100.0, 150.0, "peaked")
    g = spark.createDataFrame([("ELA", "All Grades", "1", 1), ("ELA", "overall", "2", 2), ("Math", "All of them", "3", 3), ("Math", "4", "4", 4)], "testsubject string, gradelevel string, percentmetstandard string, pos int")
    g = g.select("*", F.lit("2024").alias("schoolyear"), F.lit("District").alias("organizationlevel"), F.lit("All Students").alias("studentgroup"))
    assert sorted((r.label, r.value) for r in reports.REPORTS["assessment"].build(g, "pos").collect() if r.section == "trend") == [("ELA", 1.0), ("Math", 3.0)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t, "processing"), ("b", t, "processing"), ("b", t + datetime.timedelta(minutes=5), "complete"), ("c", t + datetime.timedelta(hours=5), "complete")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, status string")
    df.coalesce(1).write.parquet(f"{src}/p1")
    s = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    spark.createDataFrame([("d", t + datetime.timedelta(hours=6), "complete")], df.schema).coalesce(1).write.parquet(f"{src}/p2")
    out = activity.drained(activity.stale_stream(s.withWatermark("ts", "1 minute"), "k", "ts", "status"))
    assert [r.k for r in out.collect()] == ["a"]
    assert [r.k for r in activity.stale(df, "k", "ts", "status", "90 minutes", F.lit(t + datetime.timedelta(hours=6))).collect()] == ["a"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.jsonl").write_text("one\ntwo\n")
    q = activity.to_parquet(activity.json_lines_stream(spark, str(tmp_path / "j")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    (tmp_path / "j" / "y.jsonl").write_text("three\n")
    activity.to_parquet(activity.json_lines_stream(spark, str(tmp_path / "j")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_canonical_names(spark):
    from civicspark.operators import dialogue

    roster = spark.createDataFrame([(0, "Donald Cook"), (1, "Leslie Hamada"), (2, "Alm")], "pos int, name string")
    labels = ["Cook", " donald cook ", "Donald Smith", "Mr. Leslie Hamada Jr", "hamada", "x", "", None, "Al", "Alma"]
    got = {r.label: r["name"] for r in dialogue.canonical(spark.createDataFrame([(x,) for x in labels], "label string"), roster).collect()}
    assert got == {"Cook": "Donald Cook", " donald cook ": "Donald Cook", "Donald Smith": "Donald Smith", "Mr. Leslie Hamada Jr": "Leslie Hamada", "hamada": "Leslie Hamada", "x": "x", "": "", None: None, "Al": "Donald Cook", "Alma": "Alm"}  # "al" is part of "donald cook"


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_joins_without_row_identity(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(500).select((F.col("id") * 7 % 101).alias("k"), "id").repartition(5)
        parts = relational.round_robin(df, [F.col("k"), F.col("id")], 7).collect()
        want = {r: i % 7 for i, r in enumerate(sorted((x.k, x.id) for x in df.collect()))}
        assert {(r.k, r.id): r.part for r in parts} == want
        roster = spark.createDataFrame([("2020-01-01", "2020-06-30", "a", 1)], "s string, e string, n string, priority int").select(F.to_date("s").alias("start"), F.to_date("e").alias("end"), "n", "priority")
        days = df.select(F.when(F.col("k") % 2 == 0, F.lit("2020-03-01")).when(F.col("k") < 50, F.lit("2021-01-01")).cast("date").alias("day"), F.lit(1).alias("n_rows")).distinct().union(df.select(F.lit(None).cast("date"), F.lit(2)).limit(3))
        got = relational.by_interval(days, "day", roster)
        assert got.count() == days.count() and {r.n for r in got.collect()} == {"a"}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_names_stand_anywhere(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "near Foxglen", None), ("b", "no", None), ("c", None, None), ("d", "a FOX, and GLEN", None)], "k string, t string, d date")
    names = spark.createDataFrame([(1, "Fox"), (1, "glen"), (2, "ox, A"), (3, " "), (4, None)], "query_id int, name string")
    want = {(1, "a"), (1, "d"), (2, "d")}
    assert {(r.query_id, r.k) for r in retrieval.name_hits(docs, names, "k", "t", "d", 5).collect()} == want
    monkeypatch.setattr(retrieval, "NAMES_IN_TURN", 1)
    assert {(r.query_id, r.k) for r in retrieval.name_hits(docs, names, "k", "t", "d", 5).collect()} == want


def test_terms_of_any_script(spark):
    assert one(spark, "Él informó; Міська рада, 预算!", lambda c: F.array_join(retrieval.terms(c), "|")) == "él|informó|міська|рада|预|算"
    assert one(spark, "policies dresses buses bonus class as trees", lambda c: F.array_join(retrieval.stemmed_terms(c), "|")) == "policy|dresse|buse|bonus|class|tree"


def test_index_reads_like_postings(spark, tmp_path):
    from civicspark.operators import textindex

    docs = spark.createDataFrame([("a", "red fox red"), ("b", "the big fox"), ("c", None), ("d", "")], "k string, t string")
    i = textindex.build(docs, "k", "t", f"{tmp_path}/i", 4)
    q = spark.createDataFrame([(1, "red fox"), (2, "wolf")], "query_id int, text string")
    assert sorted((r.term, r.k, r.positions) for r in i.postings(q).collect()) == [("fox", "a", [1]), ("fox", "b", [1]), ("red", "a", [0, 2])]
    assert {r.k: r.dl for r in i.lengths().collect()} == {"a": 3, "b": 2, "c": 0, "d": 0}
    assert i.postings(q.limit(0)).count() == 0


def test_peers_and_stop_names(spark):
    few = spark.createDataFrame([("Ann Grey", 9), ("Bo", 3), ("Cy", 1)], "name string, n int")
    assert sorted(r.name for r in stats.peers(few, "name", "n", "grey").collect()) == ["Bo"]
    assert sorted(r.name for r in stats.peers(few, "name", "n", "Bo").collect()) == ["Ann Grey"]
    assert stats.peers(few, "name", "n", "nobody").count() == 0
    assert one(spark, "school", X.title_name) is None and one(spark, "high school", X.title_name) == "High School"
    assert [one(spark, v, X.blank_page) for v in (" This page is\n intentionally left  blank ", "Intentionally Blank", "This page is blank")] == [True, True, False]


def test_breaker():
    now = [0.0]
    b = plugins.Breaker(lambda x: 1 / x, most=2, rest_s=10, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b(0)
    with pytest.raises(ConnectionError):
        b(1)
    now[0] = 11.0
    assert b(1) == 1 and b(2) == 0.5


def test_a_cluster_needs_a_shared_folder():
    from civicspark import session

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, k, default=None):
            return self.values.get(k, default)

        def set(self, k, v):
            self.values[k] = v

    class Fake:
        def __init__(self, **values):
            self.conf = Conf({k.replace("__", "."): v for k, v in values.items()})

    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(Fake(spark__master=master))
    assert session.shared_dir(Fake(spark__master="yarn", spark__checkpoint__dir="hdfs:///x/")) == "hdfs:///x"
    assert session.shared_dir(Fake(spark__master="local[2]")).startswith("file://")
