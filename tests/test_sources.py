import datetime
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from civicspark.sources import logs, mail, meetings, office, opendata, sinks, transcripts


def test_meeting_directories(spark, tmp_path):
    for name, files in {"2024-a": {"meeting.json": "{}", "item1/item.json": "{}"}, "2024-b": {"meeting.json": "{}", "agenda.txt": "x"}, "2024-c": {"meeting.json": "{}"}, ".hidden": {"agenda.txt": "x"}}.items():
        for f, text in files.items():
            p = tmp_path / name / f
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    listing = meetings.files(spark, str(tmp_path))
    assert {r[0]: r[1] for r in meetings.formats(listing).collect()} == {"2024-a": "structured", "2024-b": "flat", "2024-c": "empty"}
    assert {r[0]: r[1] for r in meetings.format_report(listing).collect()} == {"structured": 1, "flat": 1, "empty": 1}
    assert [r.name for r in meetings.attachments(listing).collect()] == ["agenda.txt"]


def test_meeting_json(spark):
    flat = {"meeting_id": "M1", "date": "20240131", "name": "n", "slug": "s", "files_found": 2, "scraped_at": "2024-02-01T10:00:00", "source_url": "u"}
    deep = {"date": "2024-02-30", "meetingSlug": "s2", "meetingType": "t", "meetingUrl": "https://x/goto?open&id=M2", "scrapedAt": "2024-02-01T10:00:00Z", "categories": [{"categoryId": "c", "items": [{"itemId": "i"}]}]}
    df = spark.createDataFrame([(json.dumps(flat),), (json.dumps(deep),), ('{"date"',), (None,)], "content string")
    a, b, c, d = meetings.parse_meeting(df).collect()
    assert (a.layout, a.meeting_id, a.meeting_date, a.files_found, a.bad) == ("flat", "M1", datetime.date(2024, 1, 31), 2, False)
    assert (b.layout, b.meeting_id, b.meeting_date, b.slug, b.categories[0]["items"][0]["itemId"]) == ("structured", "M2", None, "s2", "i")
    assert c.bad and d.bad and c.meeting_id is None


def test_item_and_agenda(spark):
    item = {"itemId": "i", "itemName": "n", "innerHtml": '<dl><dt>Type</dt><dd>Action</dd></dl><div class="goal"><div class="name">G1</div></div>', "links": [{"order": "1", "unique": "k", "href": "h", "text": "t", "filename": "f"}]}
    r = meetings.parse_item(spark.createDataFrame([(json.dumps(item),), ("{}",)], "content string")).collect()
    assert (r[0].item_type, r[0].goals, r[0].links[0].link_key) == ("Action", ["G1"], "k")
    assert (r[1].item_type, r[1].goals, r[1].item_id) == ("Information", [], "")
    text = "preamble\nSubject\n  \n  First\nMeeting\n  M\nType\n\nFile Attachments\n ---\nSubject\n Second\nType\n Action \\---\nFile Attachments\n a.pdf\n"
    got = meetings.parse_agenda(spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "k int, t string"), "k", "t").orderBy("block").collect()
    assert [(x.subject, x.meeting, x.type, x.has_attachments) for x in got] == [("First", "M", "Information", False), ("Second", None, "Action", True)]


def test_route(spark):
    rows = [("agenda_item", None), ("x", None), ("x", "a.PPTX"), ("x", "a.doc"), ("x", "a.pdf")]
    df = spark.createDataFrame(rows, "k string, p string")
    assert [r[0] for r in df.select(meetings.extraction_route(F.col("k"), F.col("p"))).collect()] == ["html", "error", "native", "office", "ocr"]


def test_mail(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: a@x\r\nTo: b@x\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nhello\r\n--q\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=r.pdf\r\n\r\nx\r\n--q\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=r.pdf\r\n\r\ny\r\n--q--\r\n")
    (tmp_path / "b.eml").write_bytes(b"From: a@x\r\nContent-Type: text/html\r\n\r\n<p>only <b>html</b></p>")
    m = {r.path.rsplit("/", 1)[-1]: r for r in mail.read_mail(spark, str(tmp_path)).collect()}
    assert (m["a.eml"].message_id, m["a.eml"].subject, m["a.eml"].body.strip(), m["a.eml"].sent_at.year) == ("<1@x>", "Café", "hello", 2024)
    assert m["b.eml"].message_id.startswith("sha256:") and m["b.eml"].body == "only html" and m["b.eml"].sent_at is not None
    a = mail.attachment_rows(mail.read_mail(spark, str(tmp_path))).collect()
    assert sorted(r.stored_name for r in a) == ["r.pdf", "r_1.pdf"]


def test_audit_and_fs(spark):
    lines = [
        'type=SYSCALL msg=audit(1700000000.123:7): success=yes pid=5 uid=0 comm="vi" exe="/bin/vi" key="docs"', 'type=PATH msg=audit(1700000000.123:7): name="/d" nametype=PARENT', 'type=PATH msg=audit(1700000000.123:7): name="/d/f" nametype=CREATE',
        "type=CONFIG_CHANGE msg=audit(1700000001.0:8): op=x", "noise", None,
    ]
    a = logs.parse_audit(spark.createDataFrame([(x,) for x in lines], "value string"))
    (r,) = a.collect()
    assert (r.serial, r.file_path, r.command, r.pid, r.success, r.event_type, r.audit_key) == ("7", "/d/f", "vi", 5, True, "create", "docs")
    fs = logs.parse_fs(spark.createDataFrame([('{"timestamp": "2024-01-01T00:00:00Z", "event_type": "MOVED_TO", "file_path": "/a"}',), ("",), ("{broken",)], "value string"))
    n = {r.action_type for r in logs.normalised(fs, a).collect()}
    assert n == {"fs_move", "audit_create"}


def test_session_mining(spark):
    t = "\x1b[31m$ ls /opt/data/x\x1b[0m\n$ ls /opt/data/x\nValueError: error here\nWe looked at the loader for a long while and then changed it.\n"
    (r,) = logs.mine_session(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t").collect()
    assert r.commands == ["ls /opt/data/x"] and r.paths == ["/opt/data/x"] and r.errors == ["ValueError: error here"] and len(r.narrative) == 1


def test_transcripts(spark):
    asr = {"segments": [{"start": 1.0, "end": 2.0, "text": "a", "words": [{"word": "a", "score": 0.5}]}, {}]}
    s = transcripts.asr_segments(spark.createDataFrame([(1, json.dumps(asr)), (2, "{}")], "k int, p string"), "k", "p").orderBy("k", "pos").collect()
    assert [(r.k, r.pos, r.start_s, r.text, r.speaker) for r in s] == [(1, 0, 1.0, "a", None), (1, 1, 0.0, "", None), (2, None, 0.0, "", None)]
    a = [{"text": "hi", "start": 1500, "end": 1800, "speaker": "A", "confidence": 0.9}]
    b = {"results": {"channels": [{"alternatives": [{"words": [{"word": "hi", "punctuated_word": "Hi.", "start": 1.5, "end": 1.8, "speaker": 0, "confidence": 0.9}]}]}]}}
    df = spark.createDataFrame([(1, json.dumps(a)), (2, json.dumps(b))], "k int, p string")
    assert sorted((r.k, r.word, r.start_s, r.speaker) for r in transcripts.vendor_words(df, "k", "p").collect()) == [(1, "hi", 1.5, "A"), (2, "Hi.", 1.5, "0")]
    u = spark.createDataFrame([(1, json.dumps({"utterances": [{"speaker": "A", "start": 2000, "text": "x y"}]}))], "k int, p string")
    assert [(r.speaker, r.start_s, r.text) for r in transcripts.vendor_utterances(u, "k", "p").collect()] == [("A", 2.0, "x y")]


def test_wav_and_sidecar(spark, tmp_path):
    head = b"RIFF" + struct.pack("<I", 36 + 32000) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 32000)
    (tmp_path / "a.wav").write_bytes(head + b"\0" * 100)
    (tmp_path / "b.wav").write_bytes(b"junk")
    w = {r.path[-5:]: r for r in transcripts.wav_headers(spark, str(tmp_path)).collect()}
    assert (w["a.wav"].seconds, w["a.wav"].usable) == (1.0, True) and not w["b.wav"].usable
    t = transcripts.with_sidecar(spark.createDataFrame([("s", "abcdef"), ("t", "x")], "stem string, text string"), spark.createDataFrame([("s", "Title|2024-01-02")], "stem string, value string"), most=3)
    assert {(r.stem, r.text, r.title, str(r.day)) for r in t.collect()} == {("s", "abc", "Title", "2024-01-02"), ("t", "x", None, "None")}


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


def test_office(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    docx = _zip({"word/document.xml": f"<w:document {w}><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>"})
    xlsx = _zip({"xl/sharedStrings.xml": f"<sst {s}><si><t>h</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/></worksheet>'})
    pptx = _zip({"ppt/slides/slide1.xml": f"<p {a}><a:p><a:t>hi</a:t></a:p><a:tbl><a:tr><a:tc><a:p><a:t>x</a:t></a:p></a:tc><a:tc><a:p><a:t>y</a:t></a:p></a:tc></a:tr></a:tbl></p>", "ppt/notesSlides/notesSlide1.xml": f"<p {a}><a:p><a:t>n</a:t></a:p></p>"})
    df = spark.createDataFrame([("a.docx", docx), ("b.xlsx", xlsx), ("c.pptx", pptx), ("d.docx", b"broken"), ("e.pdf", b"%PDF")], "path string, content binary")
    r = {x.path: x for x in office.extract(df).collect()}
    assert r["a.docx"].text == "one\ntwo" and r["b.xlsx"].text == "h\t5" and r["c.pptx"].text == "--- Slide 1 ---\nhi\nx | y\nNotes: n"
    assert (r["d.docx"].status, r["e.pdf"].status) == ("failed", "pending")


def test_open_data(spark, tmp_path):
    rows = [{"schoolyear": "2023", "n": k, ":id": f"r{k}"} for k in range(7)]
    (tmp_path / "abc.json").write_text(json.dumps(rows))
    df = opendata.read_records(spark, str(tmp_path), ["abc", "missing"], ["schoolyear", "n", "other"], page_size=3, lanes=3)
    assert df.rdd.getNumPartitions() == 6 and sorted(r.n for r in df.collect()) == [str(k) for k in range(7)] and df.where("other is not null").count() == 0
    assert df.where("n = '4'").count() == 1
    assert opendata.read_json_array(spark, str(tmp_path / "none.json"), ["a"]).count() == 0
    assert opendata.read_json_array(spark, str(tmp_path / "abc.json"), ["n"]).count() == 7
    d = spark.createDataFrame([("1", "x", "r1"), ("1", "x", "r2"), ("2", "x", "r3")], "`a` string, `b` string, `:id` string")
    assert opendata.canonical_rows(d).count() == 2
    found = spark.createDataFrame([("a", "n", "dataset"), ("a", "m", "dataset"), ("b", "n", "map"), ("c", "n", "dataset")], "id string, name string, kind string")
    assert [tuple(r) for r in opendata.new_datasets(found, spark.createDataFrame([("c",)], "id string")).collect()] == [("a", "m")]
    assert opendata.first_with_rows([d.where("a = '9'"), d]).count() == 3


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("t", "1", "a"), ("t", None, "b")], "tenant string, ext string, v string")
    new = spark.createDataFrame([("t", "1", "x"), ("t", "2", "y"), ("t", "2", "z"), ("t", None, "w")], "tenant string, ext string, v string")
    assert sorted(r.v for r in sinks.insert_ignore(old, new, ["tenant", "ext"], "v").collect()) == ["w", "y"]
    m = spark.createDataFrame([("1", {"a": "1", "b": "1"}), ("2", None)], "id string, metadata map<string,string>")
    c = spark.createDataFrame([("1", {"b": "2", "c": "3"}), ("2", {"z": "1"})], "id string, metadata map<string,string>")
    assert {r.id: r.metadata for r in sinks.merge_metadata(m, c, "id").collect()} == {"1": {"a": "1", "b": "2", "c": "3"}, "2": {"z": "1"}}
    k = spark.createDataFrame([("d1", 0), ("d1", 1), ("d2", 0)], "doc string, i int")
    assert sinks.replace_children(k, spark.createDataFrame([("d1", 5)], "doc string, i int"), "doc").count() == 2
    assert sinks.upsert(k, k.limit(1), ["doc", "i"]).count() == 3 and sinks.delete_ids(k, k.where("doc = 'd1'"), "doc").count() == 1
    st = sinks.with_status(spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([("2", "boom")], "id string, error string"), "id")
    assert {r.id: r.status for r in st.collect()} == {"1": "complete", "2": "failed", "3": "pending"}
    a, b = f"{tmp_path}/docs", f"{tmp_path}/chunks"
    sinks.publish({a: old, b: k})
    sinks.publish({a: old.union(new), b: k.limit(1)})
    assert sinks.read(spark, a).count() == 6 and sinks.read(spark, b).count() == 1
    assert sinks.read(spark, f"{tmp_path}/none", "x int").count() == 0
    with pytest.raises(FileNotFoundError):
        sinks.read(spark, f"{tmp_path}/none")
    sinks.write_csv_union([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, a int")], f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").columns == ["a", "b", "c"]
    sinks.append_log(k, f"{tmp_path}/log")
    sinks.append_log(k, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6
    assert k.select(sinks.point_id("doc", "i").alias("p")).distinct().count() == 3


def test_all_pages_are_read(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps([{"n": k} for k in range(25)]))
    for lanes in (1, 4):
        df = opendata.read_records(spark, str(tmp_path), ["big"], ["n"], page_size=5, lanes=lanes)
        assert sorted(int(r.n) for r in df.collect()) == list(range(25))
    found = opendata.search_catalogue(lambda t: [{"id": "a", "name": t, "type": "dataset"}, {"name": "no id"}], spark, ["x", "y"])
    assert sorted(map(tuple, found.collect())) == [("a", "x", "dataset"), ("a", "y", "dataset")]
    (tmp_path / "alt.json").write_text(json.dumps([{"county": "K", "n": 1}]))
    assert opendata.probe(spark, str(tmp_path), "alt", ["org", "county", "n"], [("org", "7"), ("county", "K")]).count() == 1


def test_walk_has_empty_directories(spark, tmp_path):
    for name, files in {"a": ["agenda.txt"], "b": [], "c": ["meeting.json", "i/item.json"], ".x": ["y"]}.items():
        (tmp_path / name).mkdir()
        for f in files:
            p = tmp_path / name / f
            p.parent.mkdir(exist_ok=True)
            p.write_text("{}")
    assert sorted(map(tuple, meetings.walk(spark, str(tmp_path)).collect())) == [("a", "flat", 1), ("b", "empty", 0), ("c", "structured", 2)]
    assert [r.meeting_dir for r in meetings.walk(spark, str(tmp_path), 2).orderBy("meeting_dir").collect()] == ["a", "b"]
    (tmp_path / "a" / "meeting.json").write_text("{broken")
    assert sorted(r.bad for r in meetings.load_each(spark, str(tmp_path), meetings.parse_meeting).collect()) == [False, True]


def test_publications_are_whole(spark, tmp_path):
    import os

    a, b = f"{tmp_path}/p/a", f"{tmp_path}/p/b"
    one = spark.createDataFrame([(1,)], "x int")
    sinks.publish({a: one, b: one})
    for _ in range(3):
        sinks.publish({a: sinks.read(spark, a).union(one)})
    names = sorted(n for n in os.listdir(f"{tmp_path}/p/_published") if not n.startswith("."))
    assert names == [f"{k:012d}.json" for k in range(4)]  # none is ever changed or deleted
    assert sinks.read(spark, a).count() == 4 and sinks.read(spark, b).count() == 1
    with pytest.raises(ValueError):
        sinks.publish({a: one, f"{tmp_path}/q/c": one})


def test_tiers():
    assert office.tiered(lambda r: "x" * 100, lambda r: "y" * 200)(b"") == "x" * 100
    assert office.tiered(lambda r: "x" * 99, lambda r: "y" * 200)(b"") == "y" * 200
    assert office.tiered(lambda r: "short", lambda r: "")(b"") == "short"
    assert office.tiered(lambda r: 1 / 0, lambda r: "fallback")(b"") == "fallback"
