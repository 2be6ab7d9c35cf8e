"""Queries of deduplication and corpus diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import corpus, dedup
from civicspark.plans.scalars import _PAGE_SQL, classed_pages
from civicspark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks as points with their content as stored: one row per id."""
    return table(s, d, "chunks").dropDuplicates(["id"]).select("id", "chunk_index", "content", F.col("metadata.title").alias("title"), F.col("metadata.meeting_date").alias("meeting_date"))


_C = """c AS (SELECT id, chunk_index, content, metadata.title AS title, metadata.meeting_date AS meeting_date FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1),
     k AS (SELECT *, sha256(coalesce(content, '')) AS h, coalesce(title, '') AS t FROM c)"""


@query(f"""
    WITH {_C} SELECT h AS content_hash, t AS group_title, count(*) AS n, count(*) - 1 AS removable, min(meeting_date) AS first_date, max(meeting_date) AS last_date,
           coalesce(string_agg(DISTINCT meeting_date, ',' ORDER BY meeting_date), '') AS dates FROM k GROUP BY ALL HAVING count(*) > 1""")
def dup_groups(s: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(_chunks(s, d), "content", "title", "meeting_date")


_KEEP = """p AS (SELECT id, first_value(id) OVER w AS kept_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY h, t) AS n FROM k
                WINDOW w AS (PARTITION BY h, t ORDER BY coalesce(meeting_date, '9999'), coalesce(chunk_index, 999999), id))"""


@query(f"WITH {_C}, {_KEEP} SELECT id, kept_id, kept FROM p WHERE n > 1")
def dup_keepers(s: SparkSession, d: str) -> DataFrame:
    return dedup.keepers(_chunks(s, d), "content", "title", "meeting_date", "chunk_index", "id")


@query("SELECT title, count(DISTINCT sha256(coalesce(content_text, ''))) AS versions, min(meeting_date) AS first_date, max(meeting_date) AS last_date FROM document_records WHERE title <> '' GROUP BY 1 HAVING count(DISTINCT sha256(coalesce(content_text, ''))) > 1")
def revisions(s: SparkSession, d: str) -> DataFrame:
    return dedup.revisions(table(s, d, "document_records"), "content_text", "title", "meeting_date")


_LOW = r"""low AS (SELECT id, CASE WHEN length(regexp_replace(content, '\s', '', 'g')) < 50 AND length(regexp_replace(regexp_replace(trim(content), '^#{1,6}[ \t][^\n]*\n?', ''), '\s', '', 'g')) < 50 THEN 'short'
              WHEN regexp_matches(content, '(?i)^\s*intentionally\s+blank\s*$') THEN 'blank' END AS reason FROM c)"""
_PURGE = "SELECT id, 'duplicate' AS reason, kept_id FROM p WHERE n > 1 AND NOT kept UNION ALL SELECT id, reason, NULL FROM low WHERE reason IS NOT NULL AND id NOT IN (SELECT id FROM p WHERE n > 1 AND NOT kept)"


@query(f"WITH {_C}, {_KEEP}, {_LOW} {_PURGE}")
def purge_log(s: SparkSession, d: str) -> DataFrame:
    return dedup.purge_log(_chunks(s, d), "content", "title", "meeting_date", "chunk_index", "id")


@query(f"WITH {_C}, {_KEEP}, {_LOW}, x AS ({_PURGE}) SELECT count(*) AS rows_left, 0 AS groups_left FROM c WHERE id NOT IN (SELECT id FROM x)")
def purge_verify_zero(s: SparkSession, d: str) -> DataFrame:
    """What is left after the purge, and the duplicate groups in it (none)."""
    return _left(_chunks(s, d))


def _left(c: DataFrame) -> DataFrame:
    rest = dedup.purged(c, dedup.purge_log(c, "content", "title", "meeting_date", "chunk_index", "id"), "id")
    groups = rest.groupBy(*dedup.content_key(F.col("content"), F.col("title"))).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("rows_left"), F.count_if(F.col("n") > 1).cast("int").alias("groups_left"))


_D = _C.replace("SELECT id, chunk_index, content, metadata.title AS title, metadata.meeting_date AS meeting_date FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1", "SELECT CAST(doc_id AS VARCHAR) AS id, 0 AS chunk_index, text AS content, source AS title, CAST(meeting_date AS VARCHAR) AS meeting_date FROM documents")


def _documents(s: SparkSession, d: str) -> DataFrame:
    """Documents as points; unlike chunks they hold many exact copies."""
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.col("source").alias("title"), F.col("meeting_date").cast("string").alias("meeting_date"))


@query(f"""
    WITH {_D} SELECT h AS content_hash, t AS group_title, count(*) AS n, count(*) - 1 AS removable, min(meeting_date) AS first_date, max(meeting_date) AS last_date,
           coalesce(string_agg(DISTINCT meeting_date, ',' ORDER BY meeting_date), '') AS dates FROM k GROUP BY ALL HAVING count(*) > 1""")
def dup_groups_documents(s: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(_documents(s, d), "content", "title", "meeting_date")


@query(f"WITH {_D}, {_KEEP}, {_LOW} {_PURGE}")
def purge_log_documents(s: SparkSession, d: str) -> DataFrame:
    return dedup.purge_log(_documents(s, d), "content", "title", "meeting_date", "chunk_index", "id")


@query(f"WITH {_D}, {_KEEP}, {_LOW}, x AS ({_PURGE}) SELECT count(*) AS rows_left, 0 AS groups_left FROM c WHERE id NOT IN (SELECT id FROM x)")
def purge_verify_documents(s: SparkSession, d: str) -> DataFrame:
    return _left(_documents(s, d))


@query("SELECT doc_id, tenant_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def first_occurrence(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("text is not null").select("doc_id", "tenant_id", F.md5("text").alias("h"))
    return dedup.first_occurrence(t, [F.col("h")], [F.col("doc_id")]).select("doc_id", "tenant_id")


@query("""
    SELECT id, CASE WHEN row_number() OVER (PARTITION BY document_type || '-' || strftime(meeting_date, '%Y%m') ORDER BY id) > 1
                    THEN document_type || '-' || strftime(meeting_date, '%Y%m') || '-' || left(md5(id), 4) ELSE document_type || '-' || strftime(meeting_date, '%Y%m') END AS name
    FROM document_records WHERE meeting_date IS NOT NULL AND document_type IS NOT NULL""")
def name_collisions(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "document_records").where("meeting_date is not null and document_type is not null").select("id", F.concat("document_type", F.lit("-"), F.date_format("meeting_date", "yyyyMM")).alias("stem"))
    return dedup.unlike_names(r, "stem", "id").select("id", "name")


@query("SELECT copies, count(*) AS groups FROM (SELECT md5(text) AS h, count(*) AS copies FROM documents GROUP BY 1) GROUP BY 1")
def copies_distribution(s: SparkSession, d: str) -> DataFrame:
    return dedup.copies_distribution(table(s, d, "documents"), [F.md5("text").alias("h")])


_DOCS = f"""{_PAGE_SQL},
    g AS (SELECT document_id, count(*) AS pages, count(*) FILTER (kind = 'TEXT_RICH') AS rich, count(*) FILTER (kind = 'TEXT_SPARSE') AS sparse, count(*) FILTER (kind = 'IMAGE_ONLY') AS image, 0 AS unreadable FROM k GROUP BY 1),
    r AS (SELECT *, CASE WHEN rich / pages >= 0.9 THEN 'NATIVE_DIGITAL' WHEN rich / pages >= 0.1 THEN 'MIXED_CONTENT' ELSE 'FULLY_SCANNED' END AS class, round(rich / 200.0 + (image + sparse) / 3.0, 3) AS ocr_minutes FROM g)"""


@query(f"WITH {_DOCS} SELECT document_id, pages, rich, sparse, image, unreadable, class, ocr_minutes FROM r")
def doc_classification(s: SparkSession, d: str) -> DataFrame:
    return corpus.classify_documents(classed_pages(s, d), "document_id", "kind")


@query(f"WITH {_DOCS}, t AS (SELECT sum(ocr_minutes) AS m FROM r) SELECT 'low' AS scenario, round(m * 0.8, 6) AS minutes FROM t UNION ALL SELECT 'expected', round(m, 6) FROM t UNION ALL SELECT 'high', round(m * 1.5, 6) FROM t")
def ocr_estimate(s: SparkSession, d: str) -> DataFrame:
    x = corpus.ocr_scenarios(corpus.classify_documents(classed_pages(s, d), "document_id", "kind"))
    return x.select("scenario", F.round("minutes", 6).alias("minutes"))


@query("""
    SELECT document_type, count(*) AS n, sum(length(content_text)) AS total, round(avg(length(content_text)), 6) AS mean, max(length(content_text)) AS most, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM document_records GROUP BY 1""")
def corpus_profile(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "document_records").select("document_type", F.length("content_text").alias("size"))
    return corpus.profile(r, "document_type", "size").select("document_type", "n", "total", F.round("mean", 6).alias("mean"), "most", F.round("pct", 6).alias("pct"))


@query("SELECT coalesce(ocr_method, '(none)') AS creator, count(*) AS n FROM document_records GROUP BY 1 ORDER BY n DESC, creator LIMIT 10")
def top_creators(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_records").groupBy(F.coalesce("ocr_method", F.lit("(none)")).alias("creator")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "creator").limit(10)
