import random

from civicspark.llm import scans

WORDS = "committee budget report transfer minutes allocation resolution facility enrollment approved review quarterly department schedule before after without against year-round high-capacity".split()
SMALL = "the of and to for in a our each".split()
MODEL = scans.Model("\n".join([f"{w}\t{500}" for w in SMALL] + [f"{w}\t{50}" for w in WORDS] + ["#99\t20", "#9999\t20", "#$999,999\t9", "#A99\t5", "year\t40", "round\t40"]))


def test_hand_cases():
    page = "Budget Report Committee    3\n\nThe committ-\nee reviewed the budgct for our year-\nround facility in B29 of 2O24 and the allo¬\ncation of $123,4l5 after the\nminutes.\n\nPagc 3 0f 9"
    p = scans.decode(page, MODEL)
    want = {0: {"furniture"}, 2: {"hyphen"}, 3: {"misread"}, 4: {"hyphen", "misread"}, 5: {"misread"}, 8: {"furniture"}}
    assert {k: s for k, s in enumerate(p.kinds) if s} == want
    assert p.paragraphs == ["The committee reviewed the budget for our year-round facility in B29 of 2024 and the allocation of $123,415 after the minutes."]


def test_splits_and_merges():
    p = scans.decode("thecommittee approved the bud get for the department schedule and the quarterly review", MODEL)
    assert p.paragraphs == ["the committee approved the budget for the department schedule and the quarterly review"]


def corrupt(rng):
    """A page with known cases."""
    subs = (("e", "c"), ("o", "0"), ("l", "1"), ("t", "†"), ("m", "rn"), ("a", "@"))
    lines, truth = ["Facility Report Minutes Review"], {(0, "furniture")}
    for k in range(1, 9):
        ws = [rng.choice(SMALL if i % 2 else WORDS) for i in range(10)]
        if rng.random() < 0.5:
            i = rng.randrange(0, 9, 2)
            a, b = rng.choice([s for s in subs if s[0] in ws[i]] or [("", "")])
            if a and "-" not in ws[i]:
                ws[i] = ws[i].replace(a, b, 1)
                truth.add((k, "misread"))
        lines.append(" ".join(ws))
    out = lines[:1]
    carry = ""
    for k in range(1, 9):
        text = carry + lines[k]
        carry = ""
        if k < 8 and rng.random() < 0.5:
            w = rng.choice([w for w in WORDS if len(w) > 7 and "-" not in w])
            cut = rng.randint(3, len(w) - 3)
            text += " " + w[:cut] + rng.choice("-¬‐")
            carry = w[cut:] + " "
            truth.add((k, "hyphen"))
        out.append(text)
    out.append("- 4 -")
    truth.add((9, "furniture"))
    return "\n".join(out), truth


def test_held_out_pages():
    rng = random.Random(9)
    hit = found = true = 0
    for _ in range(150):
        text, truth = corrupt(rng)
        got = {(k, x) for k, s in enumerate(scans.decode(text, MODEL).kinds) for x in s}
        hit, found, true = hit + len(got & truth), found + len(got), true + len(truth)
    assert hit / found > 0.97 and hit / true > 0.97


def test_tables(spark):
    pages = spark.createDataFrame([("1", "tesseract", "the com-\nmittee"), ("2", "native", "the com-\nmittee"), ("3", "ocr", None), ("4", "ocr", ""), ("5", None, "x"), ("1", "tesseract", "the com-\nmittee"), ("6", "native", "the committee and the budget committee"), ("7", "ocr", "   \n\n")], "id string, extraction_method string, content_text string")
    records = spark.createDataFrame([("r", True, "a com-\nmittee\n\fbudget"), ("s", None, "the committee")], "id string, ocr_applied boolean, content_text string")
    model = scans.clean_model(pages, records)
    from pyspark.sql import functions as F

    r = {x.id: x.repaired_text for x in scans.repaired(pages, model, "content_text", ~F.col("extraction_method").isin("native", "pdf_text")).collect()}
    assert r == {"1": "the committee", "2": "the com-\nmittee", "3": None, "4": "", "5": "x", "6": "the committee and the budget committee", "7": ""}
    got = scans.line_reports(pages.where("extraction_method = 'tesseract'"), model, "id", "content_text").collect()
    assert [tuple(x) for x in got] == [("1", 0, "hyphen")]
    assert scans.line_reports(pages.limit(0), model, "id", "content_text").count() == 0
    many = {x.id: x.repaired_text for x in scans.repaired(records, model, "content_text", F.col("ocr_applied")).collect()}
    assert many["s"] == "the committee" and many["r"].startswith("a committee")


def test_long_page():
    text = "\n".join(["the committee approved the budget"] * 5000)
    assert len(scans.decode(text, MODEL).kinds) == 5000
