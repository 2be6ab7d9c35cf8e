"""Readings do not depend on the side of LEXICON that the number of words lies on."""

import random

from pyspark.sql import functions as F

from civicspark.llm import scans
from tests.llm.test_scans import WORDS


def test_words_that_stand_nowhere_alone_are_cut_apart_at_every_size(spark):
    rng = random.Random(6)
    plain = [w for w in WORDS if "-" not in w]
    want = {"s0": "budget report", "s1": "resolution transfer", "s2": "committee report"}
    scanned = {"s0": "budgetreport", "s1": "resolutiontransfer", "s2": "c0mmitteerep0rt"}
    scanned |= {f"s{k}": "".join(rng.sample(plain, rng.randint(2, 5))) for k in range(3, 40)}
    rows = [(k, True, t) for k, t in scanned.items()] + [("clean", False, " ".join(plain * 50))]
    records = spark.createDataFrame(rows, "id string, ocr_applied boolean, content_text string")
    pages = spark.createDataFrame([], "id string, extraction_method string, content_text string")
    is_scan = F.col("ocr_applied")
    whole, joined = scans.clean_model(pages, records), scans.clean_model(pages, records, 3)
    assert whole.packed is not None and joined.packed is None
    texts = [{r.id: r.repaired_text for r in scans.repaired(records.where(is_scan), m, "content_text", is_scan).collect()} for m in (whole, joined)]
    assert {k: texts[0][k] for k in want} == want
    assert texts[1] == texts[0]
    reports = [sorted(map(tuple, scans.line_reports(records.where(is_scan), m, "id", "content_text").collect())) for m in (whole, joined)]
    assert reports[0] == reports[1] == [("s2", 0, "misread")]
