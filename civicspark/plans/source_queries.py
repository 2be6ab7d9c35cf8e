"""Queries of the sources and sinks: files and payloads are made of the tables, read or written by the operator, and compared in SQL with the tables."""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.session import cut, shared_dir, table
from civicspark.sources import logs, mail, meetings, office, opendata, sinks, transcripts
from civicspark.streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# --- meeting directories -------------------------------------------------------------------------------

_M = "m AS (SELECT meeting_id, max(meeting_date) AS day, max(name) AS name, max(slug) AS slug, coalesce(max(files_found), 0) AS files, max(source_url) AS url, length(max(slug)) % 2 = 0 AS deep FROM meetings GROUP BY 1)"


def _meetings(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "meetings").groupBy("meeting_id").agg(F.max("meeting_date").alias("day"), F.max("name").alias("name"), F.max("slug").alias("slug"), F.coalesce(F.max("files_found"), F.lit(0)).alias("files"), F.max("source_url").alias("url"))
    return g.withColumn("deep", F.length("slug") % 2 == 0)


def _meeting_json() -> Column:
    """A meeting.json in one of its two layouts."""
    flat = F.to_json(F.struct("meeting_id", F.date_format("day", "yyyyMMdd").alias("date"), "name", "slug", F.col("files").alias("files_found"), F.col("url").alias("source_url")))
    items = F.array(F.struct(F.lit("i1").alias("itemId"), F.lit("1").alias("itemOrder"), F.lit("n").alias("itemName")))
    cats = F.array(F.struct(F.lit("c1").alias("categoryId"), F.lit("1").alias("categoryOrder"), F.lit("x").alias("categoryName"), items.alias("items")))
    deep = F.to_json(F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), F.col("slug").alias("meetingSlug"), F.col("name").alias("meetingType"), F.concat(F.lit("https://x/goto?open&id="), "meeting_id").alias("meetingUrl"), cats.alias("categories")))
    return F.when(F.col("deep"), deep).otherwise(flat)


@query(f"WITH {_M} SELECT meeting_id, day AS meeting_date, name, slug, CASE WHEN deep THEN 'structured' ELSE 'flat' END AS layout, CASE WHEN deep THEN 0 ELSE files END AS files_found, CASE WHEN deep THEN 'https://x/goto?open&id=' || meeting_id ELSE url END AS source_url, CASE WHEN deep THEN 'i1' END AS first_item FROM m")
def source_meeting_json(s: SparkSession, d: str) -> DataFrame:
    p = meetings.parse_meeting(_meetings(s, d).select(_meeting_json().alias("content")))
    return p.select("meeting_id", "meeting_date", "name", "slug", "layout", "files_found", "source_url", F.col("categories")[0]["items"][0]["itemId"].alias("first_item"))


@query("SELECT raw_id, payload IS NULL OR NOT json_valid(payload) AS bad FROM raw_meetings")
def source_meeting_damaged(s: SparkSession, d: str) -> DataFrame:
    """Every payload as scraped keeps its row, the damaged ones marked."""
    return meetings.parse_meeting(table(s, d, "raw_meetings").select("raw_id", F.col("payload").alias("content"))).select("raw_id", "bad")


@query(f"WITH {_M} SELECT meeting_id AS meeting_dir, CASE WHEN files = 0 THEN 'empty' WHEN deep THEN 'structured' ELSE 'flat' END AS format, CASE WHEN files = 0 THEN 1 ELSE 2 END AS n_files FROM m")
def source_meeting_walk(s: SparkSession, d: str) -> DataFrame:
    """Real directories: meeting.json in each, beside it an agenda or an item's own directory where files were found."""
    root = _folder(s, "meetings")
    m = _meetings(s, d).select("meeting_id", "deep", "files", _meeting_json().alias("content"))

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = root.removeprefix("file://")
        for b in rows:
            for mid, deep, files, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                os.makedirs(f"{base}/{mid}/item1" if deep and files else f"{base}/{mid}", exist_ok=True)
                more = [] if not files else ["item1/item.json"] if deep else ["agenda.txt"]
                for name in ["meeting.json", *more]:
                    with open(f"{base}/{mid}/{name}", "w", encoding="utf-8") as f:
                        f.write(text)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    m.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return meetings.walk(s, root)


@query("""
    WITH i AS (SELECT DISTINCT meeting_id, it.item_id AS item_id, it.item_order AS item_order, it.item_name AS item_name FROM (SELECT meeting_id, unnest(c.items) AS it FROM (SELECT meeting_id, unnest(categories) AS c FROM meetings)) WHERE it.item_id IS NOT NULL)
    SELECT meeting_id, item_id, coalesce(item_order, '') AS item_order, coalesce(item_name, '') AS item_name, 'Action' AS item_type, 'G ' || item_id AS goal, 'Body & text' AS body, 'k-' || item_id AS link_key FROM i""")
def source_item_json(s: SparkSession, d: str) -> DataFrame:
    from civicspark.operators import nested

    i = nested.items_table(table(s, d, "meetings").select("meeting_id", "categories"), ["meeting_id"]).where("item_id is not null").select("meeting_id", "item_id", "item_order", "item_name").distinct()
    html = F.concat(F.lit('<p>Body &amp; text</p><!-- <dl><dt>Type</dt><dd>No</dd></dl> --><div class="goal"><div class="name">G '), "item_id", F.lit("</div></div>"))
    typed = F.concat(F.lit("<dl><dt>Type</dt><dd>Action</dd></dl>"), F.regexp_replace(html, "<!--.*-->", ""))
    link = F.array(F.struct(F.lit("1").alias("order"), F.concat(F.lit("k-"), "item_id").alias("unique"), F.lit("h").alias("href"), F.lit("t").alias("text"), F.lit("f.pdf").alias("filename")))
    j = F.to_json(F.struct(F.col("item_id").alias("itemId"), F.col("item_order").alias("itemOrder"), F.col("item_name").alias("itemName"), typed.alias("innerHtml"), link.alias("links")))
    p = meetings.parse_item(i.select("meeting_id", j.alias("content")))
    body = F.trim(F.regexp_replace(F.regexp_replace("body", "Type Action", ""), r"G \S+$", ""))
    return p.select("meeting_id", "item_id", "item_order", "item_name", "item_type", F.get("goals", F.lit(0)).alias("goal"), body.alias("body"), F.col("links")[0]["link_key"].alias("link_key"))


@query("""
    SELECT id, CAST(b AS BIGINT) AS block, CASE WHEN b = 1 THEN NULLIF(trim(title), '') ELSE 'Second' END AS subject, CASE WHEN b = 1 THEN meeting_id END AS meeting, CASE WHEN b = 1 THEN coalesce(document_type, 'Information') ELSE 'Information' END AS type, b = 1 AND file_path IS NOT NULL AS has_attachments
    FROM document_records, (VALUES (1), (2)) v(b)""")
def source_agenda_text(s: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat_ws("\n", F.lit("preamble"), F.lit("Subject"), F.lit("  "), F.concat(F.lit("  "), e("title")), F.lit("Meeting"), e("meeting_id"), F.lit("Type"), e("document_type"), F.lit("File Attachments"), F.lit("  --- "), e("file_path"), F.lit("Subject"), F.lit("Second"), F.lit("Type"), F.lit(""), F.lit("File Attachments"), F.lit(" ---"))
    a = meetings.parse_agenda(table(s, d, "document_records").select("id", text.alias("t")), "id", "t")
    return a.select("id", "block", "subject", "meeting", "type", "has_attachments")


# --- mail, office, open data ---------------------------------------------------------------------------


@query("""
    SELECT '<' || id || '@x>' AS message_id, coalesce(title, '') AS subject, 'a@x' AS sender, CAST(epoch(date_trunc('second', created_at)) AS BIGINT) AS sent_at, md5(coalesce(content_text, '')) AS body, id || '_.pdf' AS stored_name, length(id) AS size, sha256(id) AS sha FROM document_records""")
def source_mail(s: SparkSession, d: str) -> DataFrame:
    """Messages with a plain body and two attachments of one name; the second one's stored name and content are shown."""
    r = table(s, d, "document_records").select("id", "title", "content_text", F.col("created_at").cast("timestamp").alias("at"))
    b64 = lambda c: F.base64(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))
    part = lambda n: F.concat(F.lit("--q\r\nContent-Type: application/pdf\r\nContent-Transfer-Encoding: base64\r\nContent-Disposition: attachment; filename="), F.col("id"), F.lit(".pdf\r\n\r\n"), b64(n), F.lit("\r\n"))
    raw = F.concat(
        F.lit("From: a@x\r\nTo: b@x\r\nSubject: =?utf-8?b?"), F.regexp_replace(b64(F.col("title")), r"\s", ""), F.lit("?=\r\nDate: "), F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000\r\nMessage-ID: <"), "id",
        F.lit("@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), b64(F.col("content_text")), F.lit("\r\n"),
        part(F.lit("other")), part(F.col("id")), F.lit("--q--\r\n"),
    )
    m = cut(mail.parse_mail(r.select(F.concat("id", F.lit(".eml")).alias("path"), F.encode(raw, "UTF-8").alias("content"), "at").withColumnRenamed("at", "modified")))
    a = mail.attachment_rows(m).where("stored_name like '%\\_1.pdf'")
    a = a.select("message_id", F.regexp_replace("stored_name", "_1", "_").alias("stored_name"), F.length("content").alias("size"), F.sha2("content", 256).alias("sha"))
    return m.select("message_id", "subject", "sender", F.unix_timestamp("sent_at").alias("sent_at"), F.md5("body").alias("body")).join(a, "message_id")


def _docx(df: DataFrame) -> DataFrame:
    """(path, content): word files made of (path, text), a paragraph per line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w") as z:
                    paras = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in (t or "").split("\n"))
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{paras}</w:document>')
                out.append(buf.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return df.mapInArrow(run, "path string, content binary")


@query("""
    SELECT id || CASE WHEN length(title) % 5 = 0 THEN '.xyz' ELSE '.docx' END AS path, CASE WHEN length(title) % 5 = 0 THEN 'pending' ELSE 'complete' END AS status,
           CASE WHEN coalesce(length(title) % 5, 1) <> 0 THEN md5(array_to_string(list_filter(string_split(coalesce(replace(replace(content_text, chr(12), ''), chr(13), ''), ''), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')), chr(10))) END AS text
    FROM document_records WHERE title IS NOT NULL""")
def source_office(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "document_records").where("title is not null")
    path = F.concat("id", F.when(F.length("title") % 5 == 0, ".xyz").otherwise(".docx"))
    files = _docx(r.select(path.alias("path"), F.regexp_replace("content_text", "[\f\r]", "").alias("text")))
    return office.extract(files).select("path", "status", F.md5("text").alias("text"))


def _saved(s: SparkSession, d: str, name: str) -> str:
    """A small table (nations) as an array of objects in a file; returns the folder."""
    base = _folder(s, "open")
    os.makedirs(base.removeprefix("file://"))
    rows = [{"schoolyear": str(2000 + r.n_regionkey), "n": r.n_nationkey, "name": r.n_name, ":id": f"r{r.n_nationkey}"} for r in table(s, d, "nation").orderBy("n_nationkey").collect()]
    with open(f"{base.removeprefix('file://')}/{name}.json", "w", encoding="utf-8") as f:
        json.dump(rows, f)
    return base


@query("SELECT CAST(2000 + n_regionkey AS VARCHAR) AS schoolyear, CAST(n_nationkey AS VARCHAR) AS n, n_name AS name, CAST(NULL AS VARCHAR) AS other FROM nation WHERE n_regionkey = 2")
def source_records(s: SparkSession, d: str) -> DataFrame:
    """Paged records under a filter that goes to the source; pages of two rows are read until one is short."""
    df = opendata.read_records(s, _saved(s, d, "abc"), ["abc", "missing"], ["schoolyear", "n", "name", "other"], page_size=2, lanes=2)
    return df.where("schoolyear = '2002'")


@query("SELECT CAST(2000 + n_regionkey AS VARCHAR) AS schoolyear, n_name AS name, CAST(NULL AS VARCHAR) AS other FROM nation")
def source_json_array(s: SparkSession, d: str) -> DataFrame:
    base = _saved(s, d, "abc")
    both = opendata.read_json_array(s, f"{base}/abc.json", ["schoolyear", "name", "other"])
    return both.union(opendata.read_json_array(s, f"{base}/none.json", ["schoolyear", "name", "other"]))


@query("SELECT DISTINCT 'p' || p_partkey % 700 AS id, min(p_name) AS name FROM part WHERE p_size > 10 AND 'p' || p_partkey % 700 NOT IN (SELECT 'p' || s_suppkey FROM supplier) GROUP BY 1")
def source_catalogue(s: SparkSession, d: str) -> DataFrame:
    """New entries of a catalogue: datasets only, known ids left out, each id once."""
    p = table(s, d, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 700).cast("string")).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, "dataset").otherwise("map").alias("kind"))
    return opendata.new_datasets(p, table(s, d, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("id")))


# --- transcripts and audio -----------------------------------------------------------------------------

_G = "g AS (SELECT * FROM segments WHERE meeting_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY received_at DESC) = 1)"


def _segments(s: SparkSession, d: str) -> DataFrame:
    from civicspark.operators.dialogue import latest_rows

    return latest_rows(table(s, d, "segments").where("meeting_id is not null"), "segment_id", "received_at")


@query(f"WITH {_G} SELECT segment_id, coalesce(start_s, 0) AS start_s, coalesce(end_s, 0) AS end_s, coalesce(text, '') AS text, speaker, coalesce(len(words), 0) AS n_words FROM g")
def source_asr(s: SparkSession, d: str) -> DataFrame:
    """Recognised speech: a document per segment."""
    words = F.transform("words", lambda w: F.struct(w["word"].alias("word"), w["start_s"].alias("start"), w["end_s"].alias("end"), w["score"].alias("score")))
    doc = F.to_json(F.struct(F.lit(1).alias("version"), F.array(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "speaker", words.alias("words"))).alias("segments")))
    a = transcripts.asr_segments(_segments(s, d).select("segment_id", doc.alias("p")), "segment_id", "p")
    return a.select("segment_id", "start_s", "end_s", "text", "speaker", F.size("words").alias("n_words"))


@query(f"""
    WITH {_G}, w AS (SELECT segment_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM g WHERE words IS NOT NULL)
    SELECT segment_id, CAST(pos AS INT) AS pos, CASE WHEN segment_id % 2 = 0 THEN w.word ELSE w.word || '.' END AS word, round(w.start_s, 6) AS start_s, CASE WHEN segment_id % 2 = 0 THEN 'A' ELSE '1' END AS speaker, w.score AS confidence FROM w""")
def source_vendor_words(s: SparkSession, d: str) -> DataFrame:
    """Word tokens of two vendors: one counts milliseconds, the other nests seconds deep."""
    w = _segments(s, d).where("words is not null")
    a = F.to_json(F.transform("words", lambda x: F.struct(x["word"].alias("text"), (x["start_s"] * 1000).alias("start"), (x["end_s"] * 1000).alias("end"), F.lit("A").alias("speaker"), x["score"].alias("confidence"))))
    deep = F.transform("words", lambda x: F.struct(x["word"].alias("word"), F.concat(x["word"], F.lit(".")).alias("punctuated_word"), x["start_s"].alias("start"), x["end_s"].alias("end"), F.lit(1).alias("speaker"), x["score"].alias("confidence")))
    b = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(deep.alias("words"))).alias("alternatives"))).alias("channels")).alias("results")))
    v = transcripts.vendor_words(w.select("segment_id", F.when(F.col("segment_id") % 2 == 0, a).otherwise(b).alias("p")), "segment_id", "p")
    return v.select("segment_id", "pos", "word", F.round("start_s", 6).alias("start_s"), "speaker", "confidence")


@query(f"WITH {_G} SELECT segment_id, speaker, round(start_s, 6) AS start_s, text FROM g")
def source_vendor_utterances(s: SparkSession, d: str) -> DataFrame:
    p = F.to_json(F.struct(F.array(F.struct("speaker", (F.col("start_s") * 1000).alias("start"), "text")).alias("utterances")))
    u = transcripts.vendor_utterances(_segments(s, d).select("segment_id", p.alias("p")), "segment_id", "p")
    return u.select("segment_id", "speaker", F.round("start_s", 6).alias("start_s"), "text")


@query("SELECT o_orderkey || '.wav' AS path, CASE WHEN o_orderkey % 7 > 0 THEN CAST(1 + o_orderkey % 2 AS INT) END AS channels, CASE WHEN o_orderkey % 7 > 0 THEN CAST(8000 * (1 + o_orderkey % 3) AS INT) END AS rate, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_custkey AS DOUBLE) / 10 END AS seconds, o_orderkey % 7 > 0 AND o_orderkey % 2 = 0 AND o_orderkey % 3 = 1 AS usable FROM orders")
def source_wav(s: SparkSession, d: str) -> DataFrame:
    """Headers of as many audio files as there are orders; every seventh is damaged."""
    k = F.col("o_orderkey")
    little = lambda c, n: F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("bigint"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)])
    channels, rate = 1 + k % 2, 8000 * (1 + k % 3)
    per = rate * channels * 2
    text = lambda x: F.lit(x.encode().hex())
    h = F.concat(text("RIFF"), little(F.lit(0), 4), text("WAVEfmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(channels, 2), little(rate, 4), little(per, 4), little(F.lit(4), 2), little(F.lit(16), 2), text("data"), little(per * F.col("o_custkey") / 10, 4))
    head = F.unhex(F.when(k % 7 > 0, h).otherwise(text("RIFX")))
    w = transcripts.parse_wav(table(s, d, "orders").select(F.concat(k.cast("string"), F.lit(".wav")).alias("path"), head.alias("head"), F.lit(44).cast("bigint").alias("length")))
    return w


@query("SELECT id, left(content_text, 180000) AS text, CASE WHEN meeting_date IS NOT NULL THEN title END AS title, meeting_date AS day FROM document_records WHERE title IS NULL OR NOT contains(title, '|')")
def source_sidecar(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "document_records").where("title is null or not contains(title, '|')")
    meta = r.where("meeting_date is not null").select("id", F.concat(F.coalesce("title", F.lit("")), F.lit("|"), F.col("meeting_date").cast("string")).alias("value"))
    t = transcripts.with_sidecar(r.select("id", F.col("content_text").alias("text")), meta, "id")
    return t.join(r.select("id", F.col("title").isNull().alias("none")), "id").select("id", "text", F.when(~F.col("none"), F.col("title")).alias("title"), "day")


# --- activity ------------------------------------------------------------------------------------------


def _fs_lines(s: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, with a blank and a damaged line for some."""
    kind = F.when(F.col("event_type") == "error", "MOVED_TO").otherwise(F.upper("event_type"))
    j = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), kind.alias("event_type"), F.concat(F.lit("/d/"), F.col("event_id").cast("string")).alias("file_path"), F.lit("watch").alias("source")))
    return table(s, d, "events").select(F.explode(F.array(j, F.when(F.col("event_id") % 10 == 0, " ").otherwise("{broken"))).alias("value"))


_FS = "SELECT ts AS timestamp, 'fs_' || CASE WHEN event_type = 'error' THEN 'move' ELSE event_type END AS action_type, '/d/' || event_id AS file_path, 'watch' AS actor FROM events"


@query(_FS)
def source_fs_events(s: SparkSession, d: str) -> DataFrame:
    n = logs.normalised(logs.parse_fs(_fs_lines(s, d)))
    return n.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "action_type", "file_path", "actor")


@query(_FS)
def stream_json_lines(s: SparkSession, d: str) -> DataFrame:
    """The same lines as a stream of files in two arrivals; the second run goes on where the first ended."""
    base = _folder(s, "lines")
    lines, out = _fs_lines(s, d), None
    for half in (0, 1):
        lines.where(F.pmod(F.xxhash64("value"), F.lit(2)) == half).write.mode("append").text(f"{base}/in")
        out = activity.drained(logs.normalised(logs.parse_fs(activity.json_lines_stream(s, f"{base}/in", "*.txt"))), base=base)
    return out.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "action_type", "file_path", "actor")


@query("SELECT CAST(event_id AS VARCHAR) AS serial, '/f/' || event_id AS file_path, CASE WHEN event_type = 'signup' THEN 'create' ELSE 'access' END AS event_type, 'vi' AS command, CAST(user_id AS INT) AS pid, event_type <> 'error' AS success FROM events")
def source_audit(s: SparkSession, d: str) -> DataFrame:
    """Kernel-audit text: three lines an event, the parent's path among them, and lines that are dropped."""
    e = table(s, d, "events")
    stamp = F.concat(F.lit("msg=audit("), F.format_string("%.3f", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), F.lit(":"), F.col("event_id").cast("string"), F.lit("): "))
    call = F.concat(F.lit("type=SYSCALL "), stamp, F.lit("success="), F.when(F.col("event_type") == "error", "no").otherwise("yes"), F.lit(" pid="), F.col("user_id").cast("string"), F.lit(' uid=0 comm="vi" exe="/bin/vi" key="k"'))
    parent = F.concat(F.lit("type=PATH "), stamp, F.lit('name="/f" nametype=PARENT'))
    path = F.concat(F.lit("type=PATH "), stamp, F.lit('name="/f/'), F.col("event_id").cast("string"), F.lit('" nametype='), F.when(F.col("event_type") == "signup", "CREATE").otherwise("NORMAL"))
    config = F.concat(F.lit("type=CONFIG_CHANGE "), F.regexp_replace(stamp, r":(\d+)\)", ":9$1000000)"), F.lit("op=x"))
    a = logs.parse_audit(e.select(F.explode(F.array(call, parent, path, config, F.lit("noise"))).alias("value")))
    return a.select("serial", "file_path", "event_type", "command", "pid", "success")


@query("""
    WITH c AS (SELECT user_id, 'run ' || event_type AS c, min((ts, event_id)) AS k FROM events GROUP BY ALL), p AS (SELECT user_id, '/opt/data/' || event_type AS p, min((ts, event_id)) AS k FROM events GROUP BY ALL)
    SELECT user_id, (SELECT string_agg(c, ',' ORDER BY k) FROM c WHERE c.user_id = u.user_id) AS commands, (SELECT string_agg(p, ',' ORDER BY k) FROM p WHERE p.user_id = u.user_id) AS paths FROM (SELECT DISTINCT user_id FROM events) u""")
def source_session_log(s: SparkSession, d: str) -> DataFrame:
    """A terminal log per user, with colours; distinct commands and paths in order."""
    line = F.concat(F.lit("\u001b[31m$ run "), "event_type", F.lit("\u001b[0m\nread /opt/data/"), "event_type", F.lit(" ok"))
    t = table(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    m = logs.mine_session(t, "user_id", "t")
    return m.select("user_id", F.array_join("commands", ",").alias("commands"), F.array_join("paths", ",").alias("paths"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def stream_work_queue(s: SparkSession, d: str) -> DataFrame:
    """A work queue: each batch of new events is written under its number, so a repeated batch overwrites itself."""
    base = _folder(s, "queue")
    e = table(s, d, "events").select("event_id", "user_id")
    work = lambda b, n: b.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    for half in (0, 1):
        e.where(F.pmod("event_id", F.lit(2)) == half).write.mode("append").parquet(f"{base}/in")
        activity.for_each_batch(activity.parquet_stream(s, f"{base}/in", e.schema), work, f"{base}/checkpoint").awaitTermination()
    return s.read.parquet(f"{base}/out").groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


# --- sinks ---------------------------------------------------------------------------------------------


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as they were, and a load with changed, repeated and unkeyed rows."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = c.where("k % 3 = 0").select((F.col("k") + 1).alias("k"), F.lower("v").alias("v"))
    return c.where("k % 2 = 0"), new.union(new.select("k", F.concat("v", F.lit("+")))).union(new.select(F.lit(None).cast(new.schema["k"].dataType), "v"))


_HALVES = "c AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer), o AS (SELECT * FROM c WHERE k % 2 = 0), h AS (SELECT k + 1 AS k, lower(v) AS v FROM c WHERE k % 3 = 0), n AS (SELECT * FROM h UNION ALL SELECT k, v || '+' FROM h UNION ALL SELECT NULL, v FROM h)"


@query(f"WITH {_HALVES} SELECT k, min(v) AS v FROM n WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM o) GROUP BY k UNION ALL SELECT k, v FROM n WHERE k IS NULL")
def sink_insert_ignore(s: SparkSession, d: str) -> DataFrame:
    old, new = _halves(s, d)
    return sinks.insert_ignore(old, new, ["k"], "v")


@query(f"WITH {_HALVES} SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM h) UNION ALL SELECT k, v FROM h")
def sink_upsert(s: SparkSession, d: str) -> DataFrame:
    """Published, changed and published again: readers see the last version."""
    old, new = _halves(s, d)
    t = f"{_folder(s, 'sink')}/customers"
    sinks.publish({t: old})
    for _ in range(2):  # a repeated load changes nothing
        sinks.publish({t: sinks.upsert(sinks.read(s, t), new.where("k is not null and not endswith(v, '+')"), ["k"])})
    return sinks.read(s, t)


@query("""
    SELECT 'documents' AS t, count(*) AS n, sum(n_chars) AS total FROM documents UNION ALL SELECT 'pages', count(*), sum(length(content_text)) FROM document_pages WHERE page_number > 1""")
def sink_publish_together(s: SparkSession, d: str) -> DataFrame:
    """Two tables in one publication, then one of them again."""
    base = _folder(s, "sink")
    docs, pages = table(s, d, "documents").select("doc_id", "n_chars"), table(s, d, "document_pages").select("id", "page_number", F.length("content_text").alias("n"))
    sinks.publish({f"{base}/documents": docs, f"{base}/pages": pages})
    sinks.publish({f"{base}/pages": sinks.delete_ids(sinks.read(s, f"{base}/pages"), pages.where("page_number = 1"), "page_number")})
    a, b = sinks.read(s, f"{base}/documents"), sinks.read(s, f"{base}/pages")
    total = lambda df, name, c: df.agg(F.lit(name).alias("t"), F.count("*").alias("n"), F.sum(c).alias("total"))
    return total(a, "documents", "n_chars").union(total(b, "pages", "n"))


@query("""
    SELECT id, array_to_string(list_sort(list_transform(map_entries(map_concat(coalesce(metadata, MAP {}), CASE WHEN has_tables THEN MAP {'zz': document_type, 'aa': 'x'} ELSE MAP {} END)), lambda e: e.key || '=' || coalesce(e.value, '-'))), ',') AS m FROM document_records WHERE document_type IS NOT NULL""")
def sink_merge_metadata(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "document_records").where("document_type is not null").select("id", "metadata", "has_tables", "document_type")
    more = r.where("has_tables").select("id", F.create_map(F.lit("zz"), "document_type", F.lit("aa"), F.lit("x")).alias("metadata"))
    m = sinks.merge_metadata(r, more, "id")
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))), ",")
    return m.select("id", F.coalesce(shown, F.lit("")).alias("m"))


@query("""
    SELECT id, CASE WHEN id IN (SELECT document_id FROM document_pages) THEN 'complete' WHEN processing_status = 'failed' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN processing_status = 'failed' THEN coalesce(processing_error, 'unknown') END AS error FROM document_records""")
def sink_status(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "document_records")
    done = table(s, d, "document_pages").select(F.col("document_id").alias("id"))
    failed = r.where("processing_status = 'failed'").select("id", F.coalesce("processing_error", F.lit("unknown")).alias("error"))
    return sinks.with_status(r.select("id"), done, failed, "id").select("id", "status", "error")


@query("SELECT o_custkey AS p, o_orderkey AS c FROM orders WHERE o_custkey % 4 <> 0 UNION ALL SELECT c_custkey, -c_custkey FROM customer WHERE c_custkey % 4 = 0")
def sink_replace_children(s: SparkSession, d: str) -> DataFrame:
    new = table(s, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("p"), (-F.col("c_custkey")).alias("c"))
    return sinks.replace_children(table(s, d, "orders").select(F.col("o_custkey").alias("p"), F.col("o_orderkey").alias("c")), new, "p")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT s_suppkey FROM supplier)")
def sink_delete_ids(s: SparkSession, d: str) -> DataFrame:
    return sinks.delete_ids(table(s, d, "embeddings").select("vec_id", "label"), table(s, d, "supplier").select(F.col("s_suppkey").alias("vec_id")), "vec_id")


@query("SELECT count(*) AS points, count(DISTINCT (document_id, chunk_index)) AS ids FROM (SELECT DISTINCT document_id, chunk_index FROM chunks)")
def sink_point_ids(s: SparkSession, d: str) -> DataFrame:
    """Points keyed by document and place: a repeated load of the same chunks adds none."""
    c = table(s, d, "chunks").select("document_id", "chunk_index").distinct().withColumn("point", sinks.point_id("document_id", "chunk_index"))
    twice = sinks.upsert(c, c, ["point"])
    return twice.agg(F.count("*").alias("points"), F.count_distinct("point").alias("ids"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), NULL, r_name FROM region")
def sink_csv_union(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "csv")
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    sinks.write_csv_union([n, table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("extra"))], path)
    return s.read.option("header", "true").csv(path)


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS v FROM customer")
def sink_json(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "json")
    sinks.write_json(table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("case when c_acctbal > 0 then c_mktsegment end").alias("v")), path)
    return s.read.schema("k bigint, v string").json(path)


@query("SELECT count(*) * 2 AS n, count(DISTINCT event_id) AS runs FROM events")
def sink_run_log(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "log")
    for _ in range(2):
        sinks.append_log(table(s, d, "events").select("event_id", "event_type"), path)
    return s.read.schema("event_id bigint, event_type string").json(path).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("runs"))
