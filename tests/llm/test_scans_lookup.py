"""A word model too large to broadcast reads the same, and words split or joined may hold slips."""

import random

from pyspark.sql import functions as F

from civicspark.llm import scans
from tests.llm.test_scans import MODEL, SMALL, WORDS, corrupt


def test_joined_counts_read_like_the_broadcast_model(spark):
    rng = random.Random(4)
    clean = [(f"c{k}", "native", " ".join(rng.choice(WORDS if i % 2 else SMALL) for i in range(200)) + " B29 of 2024 costs $123,415 thecommittee's") for k in range(8)]
    scanned = [(f"s{k}", "ocr", corrupt(rng)[0]) for k in range(25)]
    scanned += [("s98", "ocr", "thec0mmittee approved the bud get\n\n\fand the re-\nport of 2O24 and the year-\nround minutes 0f Xyzzy"), ("s99", "ocr", None), ("s100", "ocr", ""), ("s0", "ocr", scanned[0][2])]
    pages = spark.createDataFrame(clean + scanned, "id string, extraction_method string, content_text string")
    records = spark.createDataFrame([], "id string, ocr_applied boolean, content_text string")
    whole, joined = scans.clean_model(pages, records), scans.clean_model(pages, records, 3)
    assert whole.packed is not None and joined.packed is None
    is_scan = F.col("extraction_method") == "ocr"
    reports = [sorted(map(tuple, scans.line_reports(pages.where(is_scan), m, "id", "content_text").collect())) for m in (whole, joined)]
    assert reports[0] == reports[1] and len(reports[0]) > 50
    texts = [sorted((tuple(r) for r in scans.repaired(pages, m, "content_text", is_scan).collect()), key=str) for m in (whole, joined)]
    assert texts[0] == texts[1] and len(texts[0]) == len(clean + scanned)


def test_splits_and_unions_with_slips():
    p = scans.decode("thec0mmittee approved the budget for the dep ar tment and our fac i1ity", MODEL)
    assert p.paragraphs == ["the committee approved the budget for the department and our facility"]
