"""The whole-table queries on fixtures, by brute force."""

from civicspark.plans import dedup_queries, relational, scalars, stats_queries


def test_holm_takes_every_order(spark, tmp_path):
    keys = [*range(0, 200), *range(1990, 2300), 10**6]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for g in range(50):
        p = sorted((k * 7919 % 10007 / 10007.0 * 0.02, k) for k in keys if k % 50 == g)
        go = True
        for i, (x, k) in enumerate(p):
            go = go and x < 0.05 / (len(p) - i)
            want[k] = go
    got = {r.k: r.rejected for r in stats_queries.QUERIES["holm"](spark, str(tmp_path)).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_every_segment_is_aligned(spark, tmp_path):
    rows = [(i, i % 3, float(i * 7 % 400), f"t{i}") for i in range(60)] + [(60, 9, 1.0, "alone")]
    spark.createDataFrame(rows, "segment_id bigint, meeting_id bigint, start_s double, text string").write.parquet(f"{tmp_path}/segments.parquet")
    want = {}
    for i, m, t, _ in rows:
        near = sorted((u, x) for _, n, u, x in rows if n == m and t - 5 <= u <= t + 30)
        want[i] = (len(near), " ".join(x for _, x in near))
    assert {r.segment_id: (r.n, r.text) for r in relational.QUERIES["window_align_join"](spark, str(tmp_path)).collect()} == want


LONG = "The board approved the budget of the coming year after a long debate about "


def chunks(spark, path):
    rows = [
        ("a", 3, LONG + "schools", "t", "2024-01-02"), ("b", 8, LONG + "roads", "t", "2024-01-01"), ("c", 3, LONG + "schools", "t", "2024-01-01"), ("d", 4, LONG + "schools", "t", None),
        ("e", 5, LONG + "schools", "other", None), ("f", 0, "too short", "t", None), ("g", 1, "Intentionally" + " " * 60 + "blank", "t", None), ("h", 2, "# " + "Header " * 12, "t", None), ("i", 2, None, "t", None),
    ]
    c = spark.createDataFrame([(i, k, x, (t, m)) for i, k, x, t, m in rows], "id string, chunk_index int, content string, metadata struct<title string, meeting_date string>")
    c.write.parquet(f"{path}/chunks.parquet")
    return {r[0]: r for r in rows}


def test_stored_texts_are_purged_whole(spark, tmp_path):
    chunks(spark, tmp_path)
    q = lambda name: dedup_queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r.n, r.group_title, r.dates) for r in q("dup_groups")] == [(3, "t", "2024-01-01,2024-01-02")]
    assert {(r.id, r.kept_id, r.kept) for r in q("dup_keepers")} == {("a", "c", False), ("c", "c", True), ("d", "c", False)}
    assert {(r.id, r.reason, r.kept_id) for r in q("purge_log")} == {("a", "duplicate", "c"), ("d", "duplicate", "c"), ("f", "short", None), ("g", "short", None)}
    assert [tuple(r) for r in q("purge_verify_zero")] == [(5, 0)]


def test_stored_texts_are_classed_whole(spark, tmp_path):
    rich = "some words of a page " * 40
    pages = [(f"p{n}", "d", n, x) for n, x in [(3, rich), (4, rich), (7, rich), (8, "a few words"), (11, ""), (12, None)]]
    spark.createDataFrame(pages, "id string, document_id string, page_number int, content_text string").write.parquet(f"{tmp_path}/document_pages.parquet")
    got = {r.id: r.kind for r in scalars.QUERIES["page_classes"](spark, str(tmp_path)).collect()}
    assert got == {"p3": "TEXT_RICH", "p4": "TEXT_RICH", "p7": "TEXT_RICH", "p8": "TEXT_SPARSE", "p11": "IMAGE_ONLY", "p12": "IMAGE_ONLY"}
    r = dedup_queries.QUERIES["doc_classification"](spark, str(tmp_path)).first()
    assert (r.pages, r.rich, r.sparse, r.image, r["class"], r.ocr_minutes) == (6, 3, 1, 2, "MIXED_CONTENT", 1.015)
    e = {r.scenario: r.minutes for r in dedup_queries.QUERIES["ocr_estimate"](spark, str(tmp_path)).collect()}
    assert e == {"low": 0.812, "expected": 1.015, "high": 1.5225}
    chunks(spark, tmp_path)
    low = {r.id: r["class"] for r in scalars.QUERIES["low_value_class"](spark, str(tmp_path)).collect()}
    assert low == {"a": None, "b": None, "c": None, "d": None, "e": None, "f": "short", "g": "short", "h": "header", "i": None}
