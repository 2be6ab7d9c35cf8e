"""E-mail files (.eml) as rows; attachments as rows of their own."""

from __future__ import annotations

import email
import email.policy
import email.utils
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.functions import text as X

MAIL = "path string, message_id string, subject string, sender string, recipients string, sent_at string, body string, is_html boolean, attachments array<struct<position:int,filename:string,size:bigint,sha256:string,content:binary>>, error string"
#: Extensions of attachments that are kept.
KEPT = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".pptx")


def _parse(path: str, raw: bytes) -> dict:
    row: dict = dict.fromkeys(("path", "message_id", "subject", "sender", "recipients", "sent_at", "body", "is_html", "attachments", "error"))
    row["path"] = path
    try:
        m = email.message_from_bytes(raw, policy=email.policy.default)
        plain, html = m.get_body(("plain",)), m.get_body(("html",))
        row["message_id"] = (m["Message-ID"] or "").strip() or "sha256:" + hashlib.sha256(raw).hexdigest()
        row |= {"subject": str(m["Subject"] or ""), "sender": str(m["From"] or ""), "recipients": str(m["To"] or "")}
        when = email.utils.parsedate_to_datetime(m["Date"]) if m["Date"] else None
        row["sent_at"] = when.isoformat() if when else None
        part = plain or html
        row["body"] = part.get_content() if part else ""
        row["is_html"] = plain is None and html is not None
        row["attachments"] = [
            {"position": k, "filename": re.sub(r"[^\w.\- ]", "_", a.get_filename() or "attachment"), "size": len(c), "sha256": hashlib.sha256(c).hexdigest(), "content": c}
            for k, a in enumerate(m.iter_attachments())
            if (a.get_filename() or "").lower().endswith(KEPT)
            for c in [a.get_payload(decode=True) or b""]
        ]
    except Exception as e:  # a damaged message is a row with its error, never a failed task
        row["error"] = f"{type(e).__name__}: {e}"[:500]
    return row


def read_mail(spark: SparkSession, root: str) -> DataFrame:
    """One row per .eml file below root: plain body preferred, else the HTML body as text; the file's time stands in for a missing date.

    message_id is the header's, else a hash of the file. A damaged file has an error and otherwise nulls.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(root)
    return parse_mail(files.select("path", "content", F.col("modificationTime").alias("modified")))


def parse_mail(files: DataFrame) -> DataFrame:
    """The same of rows (path, content, modified) from anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((n, pa.string()) for n in ("path", "message_id", "subject", "sender", "recipients", "sent_at", "body")), ("is_html", pa.bool_()), ("attachments", pa.list_(pa.struct([("position", pa.int32()), ("filename", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())]))), ("error", pa.string()), ("modified", pa.timestamp("us", "UTC"))])
        for b in batches:
            rows = [_parse(p, c) | {"modified": t} for p, c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    m = files.select("path", "content", "modified").mapInArrow(run, MAIL + ", modified timestamp")
    m = m.withColumn("body", F.when(F.col("is_html"), X.html_text(F.col("body"))).otherwise(F.col("body")))
    return m.withColumn("sent_at", F.coalesce(F.try_to_timestamp("sent_at"), F.col("modified"))).drop("modified")


def attachment_rows(mail: DataFrame) -> DataFrame:
    """(message_id, filename, stored_name, size, sha256, content): equal names of a message get _1, _2 ... before their extension."""
    a = mail.select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.*")
    n = F.row_number().over(Window.partitionBy("message_id", "filename").orderBy("position")) - 1
    a = a.withColumn("n", n)
    stored = F.when(F.col("n") == 0, F.col("filename")).otherwise(F.concat(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit("_"), F.col("n").cast("string"), F.regexp_extract("filename", r"(\.[^.]*)$", 1)))
    return a.select("message_id", "filename", stored.alias("stored_name"), "size", "sha256", "content")
