"""Meeting directories: listing, classification and parsing of meeting.json, item.json and agenda.txt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.functions import text as X

#: Files of a meeting directory that do not make it a flat one.
IGNORED = ["meeting.json", "manifest.json"]


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, meeting_dir, sub_dir, name, length, modified): every visible file below the directories of `root`.

    The listing is distributed by the file source; contents are not read. A directory without files has no row.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    base = root.rstrip("/").removeprefix("file://")
    rel = F.split(F.regexp_replace(F.substring_index("path", f"{base}/", -1), "^/", ""), "/")
    f = f.withColumn("rel", rel).where(~F.exists("rel", lambda x: x.startswith("."))).where(F.size("rel") >= 2)
    return f.select("path", F.get("rel", F.lit(0)).alias("meeting_dir"), F.when(F.size("rel") > 2, F.get("rel", F.lit(1))).alias("sub_dir"), F.element_at("rel", -1).alias("name"), "length", "modified")


def directories(spark: SparkSession, root: str, first: int | None = None) -> DataFrame:
    """(meeting_dir): the visible directories below root by name, the first ones only if asked for; empty ones are among them."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith((".", "_")))
    return spark.createDataFrame([(n,) for n in names[:first]], "meeting_dir string")


def walk(spark: SparkSession, root: str, first: int | None = None) -> DataFrame:
    """(meeting_dir, format, n_files) of every directory (or the first ones), those without a file included."""
    listing = files(spark, root)
    n = listing.groupBy("meeting_dir").agg(F.count("*").alias("n_files"))
    d = directories(spark, root, first).join(formats(listing), "meeting_dir", "left").join(n, "meeting_dir", "left")
    return d.select("meeting_dir", F.coalesce("format", F.lit("empty")).alias("format"), F.coalesce("n_files", F.lit(0)).alias("n_files"))


def load_each(spark: SparkSession, root: str, parse: Callable[[DataFrame], DataFrame], name: str = "meeting.json") -> DataFrame:
    """parse over the files called `name`, a row per file; what one damaged file lacks is null in its row alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return parse(f.select("path", F.decode("content", "UTF-8").alias("content")))


def formats(listing: DataFrame) -> DataFrame:
    """(meeting_dir, format): structured (has a subdirectory), flat (an agenda or any other file), else empty."""
    flat = F.col("sub_dir").isNull() & ~F.col("name").isin(IGNORED)
    g = listing.groupBy("meeting_dir").agg(F.bool_or(F.col("sub_dir").isNotNull()).alias("s"), F.bool_or(flat).alias("f"))
    return g.select("meeting_dir", F.when(F.col("s"), "structured").when(F.col("f"), "flat").otherwise("empty").alias("format"))


def format_report(listing: DataFrame) -> DataFrame:
    return formats(listing).groupBy("format").agg(F.count("*").alias("n"))


def attachments(listing: DataFrame) -> DataFrame:
    return listing.withColumn("extension", X.attachment_extension(F.col("name"))).where("extension is not null")


_ITEMS = "array<struct<itemId:string,itemOrder:string,itemName:string>>"
_MEETING = f"meeting_id string, date string, name string, unid string, committee_id string, slug string, files_found int, scraped_at string, source_url string, meetingSlug string, meetingType string, meetingUrl string, scrapedAt string, categories array<struct<categoryId:string,categoryOrder:string,categoryName:string,items:{_ITEMS}>>"


def parse_meeting(df: DataFrame, payload: str = "content") -> DataFrame:
    """df with the fields of either meeting.json layout (told apart by `categories`); `bad` marks text that is no object.

    Rows are never dropped: damaged ones keep nulls and bad = true.
    """
    j = F.from_json(payload, _MEETING, {"mode": "PERMISSIVE"})
    d = df.withColumn("__j", j)
    g = lambda c: F.col(f"__j.{c}")
    structured = g("categories").isNotNull()
    bad = F.col(payload).isNull() | F.get_json_object(payload, "$").isNull()
    return d.select(
        *df.columns, F.when(structured, "structured").otherwise("flat").alias("layout"), F.coalesce(X.nonempty(g("meeting_id")), X.query_parameter(g("meetingUrl"), "id")).alias("meeting_id"),
        X.loose_date(g("date")).alias("meeting_date"), F.coalesce(g("name"), g("meetingType")).alias("name"), F.coalesce(g("slug"), g("meetingSlug")).alias("slug"), g("unid").alias("unid"), g("committee_id").alias("committee_id"),
        F.coalesce(g("files_found"), F.lit(0)).alias("files_found"), F.coalesce(g("source_url"), g("meetingUrl")).alias("source_url"), X.iso_timestamp(F.coalesce(g("scraped_at"), g("scrapedAt"))).alias("scraped_at"), g("categories").alias("categories"), bad.alias("bad"),
    )


_ITEM = "itemId string, itemOrder string, itemName string, itemSlug string, itemUrl string, innerHtml string, links array<struct<order:string,`unique`:string,href:string,text:string,filename:string>>"


def parse_item(df: DataFrame, payload: str = "content") -> DataFrame:
    """df with item_id, item_order, item_name, item_slug, item_url, item_type, goals, body and links of an item.json."""
    d = df.withColumn("__j", F.from_json(payload, _ITEM, {"mode": "PERMISSIVE"}))
    g = lambda c: F.coalesce(F.col(f"__j.{c}"), F.lit(""))
    links = F.transform(F.coalesce("__j.links", F.array()), lambda x: F.struct(x["order"].alias("link_order"), x["unique"].alias("link_key"), x["href"].alias("href"), x["text"].alias("link_text"), x["filename"].alias("filename")))
    html = g("innerHtml")
    return d.select(
        *df.columns, g("itemId").alias("item_id"), g("itemOrder").alias("item_order"), g("itemName").alias("item_name"), g("itemSlug").alias("item_slug"), g("itemUrl").alias("item_url"),
        X.definition(html, "Type", "Information").alias("item_type"), X.goal_names(html).alias("goals"), X.html_text(html).alias("body"), links.alias("links"),
    )


#: The labels of an agenda's blocks.
LABELS = ["Subject", "Meeting", "Category", "Type", "Goals", "File Attachments"]


def parse_agenda(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, subject, meeting, category, type, goals, has_attachments) per block of an agenda.txt.

    Lines before the first `Subject` are skipped; a block runs to the next one. The first non-empty line under a label is its value
    (dashes cleaned); an empty Type is Information; a block has attachments if any line under File Attachments says more than dashes.
    """
    ln = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "raw")).withColumn("line", X.strip(F.col("raw")))
    w = Window.partitionBy(key).orderBy("pos")
    ln = ln.withColumn("block", F.sum(F.when(F.col("line") == "Subject", 1).otherwise(0)).over(w)).where("block > 0")
    is_label = F.col("line").isin(LABELS)
    ln = ln.withColumn("label", F.last(F.when(is_label, F.col("line")), ignorenulls=True).over(Window.partitionBy(key, "block").orderBy("pos"))).where(~is_label)
    val = X.clean_dashes(F.col("line"))
    first = lambda lab: F.min_by(F.when((F.col("label") == lab) & (val != ""), val), F.when((F.col("label") == lab) & (val != ""), F.col("pos")))
    return ln.groupBy(key, "block").agg(
        first("Subject").alias("subject"), first("Meeting").alias("meeting"), first("Category").alias("category"), F.coalesce(first("Type"), F.lit("Information")).alias("type"), first("Goals").alias("goals"),
        F.bool_or((F.col("label") == "File Attachments") & (val != "")).alias("has_attachments"),
    )


def extraction_route(kind: Column, path: Column) -> Column:
    """Which extractor a record goes to: html, native (slides), office, ocr, or error without a path."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return (
        F.when(kind == "agenda_item", "html").when(F.coalesce(path, F.lit("")) == "", "error").when(ext.isin("pptx", "ppsx"), "native")
        .when(ext.isin("doc", "docx", "xls", "xlsx", "ppt"), "office").otherwise("ocr")
    )
