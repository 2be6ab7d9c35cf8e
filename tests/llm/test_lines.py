import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicspark.llm import lines

SRC = ["tenant", "kind"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=30), min_size=1, max_size=120), st.integers(1, 4))
def test_summaries_lose_no_frequent_line(docs, parts):
    held = [lines.Summary() for _ in range(parts)]
    for k, d in enumerate(docs):
        held[k % parts].add(list(set(d)), 0.2)
    loss = sum(h.loss for h in held)
    for x in range(401):
        true = sum(x in d for d in docs)
        est = sum(h.counts.get(x, 0) for h in held)
        assert est <= true <= est + loss
        assert true < 0.2 * len(docs) or est + loss >= 0.2 * len(docs)


def rows():
    rng = random.Random(4)
    out = []
    for k in range(30):
        body = ["line " + "".join(rng.choice("abcdefgh") for _ in range(14)) for _ in range(6)]
        body.insert(rng.randrange(6), f"Printed  {k}/{k + 1}/2024\r" if k % 2 else f"PRINTED {k},{k}00")
        if k < 4:
            body.append("rare line")
        body += ["", "  "]
        out.append((f"d{k}", "t", "a" if k < 25 else None, "\n".join(body), "keep"))
    return out


def brute(data):
    import re

    key = lambda x: re.sub(r"\d(?:[\d.,:/-]*\d)?", "0", re.sub(r"\s+", "", x.lower()))
    docs = {}
    for i, t, k, text, _ in data:
        if text:
            docs[t, k, i] = text.split("\n")
    found = set()
    for (t, k, i), ls in docs.items():
        mine = [v for (a, b, _), v in docs.items() if (a, b) == (t, k)]
        for n, x in enumerate(ls):
            if key(x) and (c := sum(any(key(y) == key(x) for y in v) for v in mine)) >= 5 and c >= 0.2 * len(mine):
                found.add((i, n))
    return found


def test_found_and_clean(spark):
    data = rows() + [("n", "t", "a", None, "k"), ("e", "t", "a", "", "k"), rows()[0]]
    df = spark.createDataFrame(data, "id string, tenant string, kind string, text string, source string")
    got = {(r.document_id, r.line_no) for r in lines.found_lines(df, SRC, "id", "text").collect()}
    assert got == brute(data) and len(got) == 30
    c = lines.without_repeated_lines(df, SRC, "id", "text", skip=F.col("id") == "d3").collect()
    assert len(c) == len(data)
    by = {r.id: r for r in c}
    assert by["n"].clean_text is None and by["e"].clean_text == "" and by["d3"].lines_cut == 0 and by["d5"].lines_cut == 1 and "rinted" not in by["d5"].clean_text.lower() and by["d5"].source == "keep"
    assert by["d5"].clean_text.count("\n") == next(t for i, _, _, t, _ in data if i == "d5").count("\n") - 1
    assert lines.found_lines(df.limit(0), SRC, "id", "text").count() == 0
    with pytest.raises(ValueError):
        lines.without_repeated_lines(df.withColumn("clean_text", F.lit(1)), SRC, "id", "text")


def test_long_text(spark):
    text = "\n".join(f"{chr(97 + k % 26)}{'x' * (k % 97)} unique {'y' * (k // 97)}" for k in range(20000)) + "\nshared end"
    df = spark.createDataFrame([(f"d{k}", "t", "a", text.replace("unique", "u" * (k + 1))) for k in range(6)], "id string, tenant string, kind string, text string")
    assert {r.line_no for r in lines.found_lines(df, SRC, "id", "text").collect()} == {20000}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_against_sql(spark):
    import duckdb

    from civicspark.llm import queries

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view document_records as select * from '{d}/document_records.parquet'")
    assert {tuple(r) for r in queries.p4_found(spark, d).collect()} == set(c.execute(queries.SQL["p4_found"]).fetchall())


def test_summaries_that_are_handed_on_early_find_the_same(spark, monkeypatch):
    rows = [(f"d{k}", f"s{k % 3}", "\n".join(["Legal notice", f"own line {chr(97 + k)}", "Share this"][: 2 + k % 2])) for k in range(24)]
    df = spark.createDataFrame(rows, "id string, src string, content_text string")
    want = sorted(map(tuple, lines.found_lines(df, ["src"]).collect()))
    plain = lines._candidates
    monkeypatch.setattr(lines, "_candidates", lambda keys, docs, share: plain(keys, docs, share, 2))
    monkeypatch.setattr(lines, "BROADCAST_LINES", 1)
    assert sorted(map(tuple, lines.found_lines(df, ["src"]).collect())) == want and want
