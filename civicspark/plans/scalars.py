"""Queries over the scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import text as X
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


#: A small dictionary of our own for the overlay test.
COMMON = ["the", "a", "an", "and", "of", "for", "in", "on", "to", "with", "under", "our", "each", "no", "as", "by", "from", "before", "after", "during", "against", "since"]
_COMMON_SQL = "[" + ", ".join(f"'{w}'" for w in COMMON) + "]"


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_records")


@query("""
    SELECT meeting_id, raw, CASE WHEN regexp_full_match(raw, '\\d{8}') THEN CAST(try_strptime(raw, '%Y%m%d') AS DATE)
           WHEN regexp_full_match(raw, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(raw AS DATE) END AS parsed
    FROM (SELECT meeting_id, CASE hash_no % 3 WHEN 0 THEN strftime(meeting_date, '%Y%m%d') WHEN 1 THEN strftime(meeting_date, '%Y-%m-%d') ELSE name END AS raw
          FROM (SELECT DISTINCT meeting_id, meeting_date, name, length(slug) AS hash_no FROM meetings))""")
def parse_dates(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "meetings").select("meeting_id", "meeting_date", "name", F.length("slug").alias("k")).distinct()
    raw = F.when(F.col("k") % 3 == 0, F.date_format("meeting_date", "yyyyMMdd")).when(F.col("k") % 3 == 1, F.date_format("meeting_date", "yyyy-MM-dd")).otherwise(F.col("name"))
    return m.select("meeting_id", raw.alias("raw")).withColumn("parsed", X.loose_date(F.col("raw")))


@query("""
    SELECT raw_id, TRY_CAST(replace(regexp_extract(payload, '"scraped_?[aA]t": *"([^"]*)"', 1), 'Z', '') AS TIMESTAMP) AS scraped_at FROM raw_meetings
    WHERE payload IS NOT NULL""")
def iso_timestamps(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "raw_meetings").where("payload is not null")
    return r.select("raw_id", X.iso_timestamp(F.regexp_extract("payload", '"scraped_?[aA]t": *"([^"]*)"', 1)).cast("timestamp_ntz").alias("scraped_at"))


@query("""
    WITH f AS (SELECT segment_id, 'Regular_Board_Meeting_' || (segment_id % 13) || '_' || (segment_id % 30) || '_' ||
                      CASE segment_id % 3 WHEN 0 THEN '19' WHEN 1 THEN '2021' ELSE '7' END || '.mp3' AS name FROM segments)
    SELECT DISTINCT name, TRY_CAST(lpad(CASE WHEN CAST(y AS INT) < 100 THEN CAST(CAST(y AS INT) + 2000 AS VARCHAR) ELSE y END, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS day,
           'Regular Board Meeting' AS kind
    FROM (SELECT name, regexp_extract(name, '(\\d{1,2})_(\\d{1,2})_(\\d{2,4})\\.mp3$', 1) AS m, regexp_extract(name, '(\\d{1,2})_(\\d{1,2})_(\\d{2,4})\\.mp3$', 2) AS dd,
                 NULLIF(regexp_extract(name, '(\\d{1,2})_(\\d{1,2})_(\\d{2,4})\\.mp3$', 3), '') AS y FROM f)""")
def file_dates(s: SparkSession, d: str) -> DataFrame:
    i = F.col("segment_id")
    year = F.when(i % 3 == 0, "19").when(i % 3 == 1, "2021").otherwise("7")
    name = F.concat(F.lit("Regular_Board_Meeting_"), (i % 13).cast("string"), F.lit("_"), (i % 30).cast("string"), F.lit("_"), year, F.lit(".mp3"))
    f = table(s, d, "segments").select(name.alias("name")).distinct()
    return f.select("name", X.file_date(F.col("name")).alias("day"), X.file_meeting_type(F.col("name")).alias("kind"))


@query("""
    SELECT DISTINCT strftime(meeting_date, '%d%b%Y') || '_audio' AS name, meeting_date AS day FROM meetings WHERE meeting_date IS NOT NULL""")
def month_name_dates(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "meetings").where("meeting_date is not null").select(F.concat(F.date_format("meeting_date", "ddMMMyyyy"), F.lit("_audio")).alias("name")).distinct()
    return m.select("name", X.month_name_date(F.col("name")).alias("day"))


@query("""
    SELECT name, CASE WHEN lower(name) LIKE '%regular meeting%' THEN 'Regular Meeting' WHEN lower(name) LIKE '%special meeting%' THEN 'Special Meeting'
        WHEN lower(name) LIKE '%executive session%' THEN 'Executive Session' WHEN lower(name) LIKE '%work session%' THEN 'Work Session' WHEN lower(name) LIKE '%workshop%' THEN 'Work Session'
        WHEN lower(name) LIKE '%study session%' THEN 'Study Session' WHEN lower(name) LIKE '%retreat%' THEN 'Retreat' ELSE left(name, 255) END AS kind, count(*) AS n
    FROM meetings GROUP BY ALL""")
def meeting_type_norm(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "meetings").groupBy("name", X.meeting_type(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


@query("""
    SELECT r.id, rtrim(t.base_url, '/') || '/goto?open&id=' || coalesce(NULLIF(r.agenda_item_id, ''), NULLIF(r.meeting_id, '')) AS link,
           CASE WHEN regexp_matches(lower(r.source_url), '^https?://') THEN r.source_url END AS url, NULLIF(regexp_extract(r.source_url, '[?&]id=([^&#]*)', 1), '') AS url_id
    FROM document_records r JOIN tenants t USING (tenant_id)""")
def permalinks(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).join(table(s, d, "tenants").select("tenant_id", "base_url"), "tenant_id")
    return r.select("id", X.permalink(F.col("base_url"), F.col("meeting_id"), F.col("agenda_item_id")).alias("link"), X.safe_url(F.col("source_url")).alias("url"), X.query_parameter(F.col("source_url"), "id").alias("url_id"))


_RAW_NUMBER_SQL = "CASE l_linenumber % 5 WHEN 0 THEN '<' || l_quantity || '%' WHEN 1 THEN 'N<20' WHEN 2 THEN 'Suppressed: N<10' WHEN 3 THEN '1,' || CAST(CAST(l_quantity + 100 AS INT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END"


@query(f"""
    SELECT l_orderkey, l_linenumber, raw, coalesce(CASE WHEN lower(raw) NOT LIKE '%suppress%' THEN TRY_CAST(regexp_replace(trim(regexp_replace(raw, '[%,]', '', 'g')), '^[<>]', '') AS DOUBLE) END, 0.0) AS v
    FROM (SELECT l_orderkey, l_linenumber, {_RAW_NUMBER_SQL} AS raw FROM lineitem)""")
def suppressed_numbers(s: SparkSession, d: str) -> DataFrame:
    k, q = F.col("l_linenumber") % 5, F.col("l_quantity")
    raw = (
        F.when(k == 0, F.concat(F.lit("<"), q.cast("string"), F.lit("%"))).when(k == 1, "N<20").when(k == 2, "Suppressed: N<10")
        .when(k == 3, F.concat(F.lit("1,"), (q + 100).cast("int").cast("string"))).otherwise(q.cast("string"))
    )
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw")).withColumn("v", X.suppressed_number(F.col("raw")))


@query("""
    SELECT id, regexp_replace(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 20), '-+$', '') AS slug,
           sha256(content_text) AS sha, md5(content_text) AS md5, left(md5(content_text), 4) AS short
    FROM document_records""")
def slugs_and_hashes(s: SparkSession, d: str) -> DataFrame:
    t = F.col("content_text")
    return _records(s, d).select("id", X.slug(F.col("title"), 20).alias("slug"), F.sha2(t, 256).alias("sha"), F.md5(t).alias("md5"), F.left(F.md5(t), F.lit(4)).alias("short"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(rf"""
    WITH c AS (SELECT id, metadata.title AS title, content AS t FROM chunks),
         h AS (SELECT *, {_STRIP.format("regexp_replace(" + _STRIP.format("t") + r", '^#{1,6}[ \t][^\n]*\n?', '')")} AS body FROM c)
    SELECT id, length(regexp_replace(t, '\s', '', 'g')) AS dense,
           CASE WHEN length(regexp_replace(t, '\s', '', 'g')) < 50 AND length(regexp_replace(body, '\s', '', 'g')) < 50 THEN 'short'
                WHEN regexp_matches(t, '(?i)^\s*(this\s+page\s+(is\s+)?intentionally\s+(left\s+)?blank)\s*$') OR regexp_matches(t, '(?i)^\s*intentionally\s+blank\s*$') THEN 'blank'
                WHEN body = '' OR lower(body) = lower({_STRIP.format("coalesce(title, '')")}) THEN 'header' END AS class
    FROM h""")
def low_value_class(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").select("id", "content", F.col("metadata.title").alias("title"))
    return c.select("id", X.dense_length(F.col("content")).alias("dense"), X.low_value(F.col("content"), F.col("title")).alias("class"))


_PAGE_SQL = r"""
    p AS (SELECT id, document_id, page_number, content_text AS t, 484704.0 AS area FROM document_pages),
    q AS (SELECT *, length(regexp_replace(coalesce(t, ''), '^\s+|\s+$', '', 'g')) AS n, len(list_filter(string_split_regex(coalesce(t, ''), '\s+'), lambda x: length(x) >= 3)) AS w FROM p),
    k AS (SELECT *, CASE WHEN n > 100 AND n / area > 0.001 AND w >= 3 THEN 'TEXT_RICH' WHEN n >= 10 THEN 'TEXT_SPARSE' ELSE 'IMAGE_ONLY' END AS kind FROM q)"""


def classed_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages with their whole text and its class."""
    p = table(s, d, "document_pages").select("id", "document_id", "page_number", F.col("content_text").alias("t"))
    return p.withColumn("kind", X.page_class(F.col("t"), F.lit(484704.0)))


@query(f"""
    WITH {_PAGE_SQL}
    SELECT id, page_number, kind, kind = 'TEXT_SPARSE' AND len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) >= 5
        AND len(list_filter(list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> ''), lambda x: list_contains({_COMMON_SQL}, trim(x, '.,;:!?()[]{{}}"''')))) / len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) < 0.1 AS overlay FROM k""")
def page_classes(s: SparkSession, d: str) -> DataFrame:
    p = classed_pages(s, d)
    return p.select("id", "page_number", "kind", X.ocr_overlay(F.col("t"), F.col("kind"), COMMON, ratio=0.1).alias("overlay"))


_HTML_SQL = "'<!-- note --><div><dl><dt> Type </dt><dd> ' || coalesce(document_type, '') || ' </dd></dl><p>' || coalesce(title, '') || '</p><style>p {}</style>A &amp; B<br/></div><div class=\"goal\"><div class=\"name\">' || coalesce(committee_name, '') || '</div></div>'"


def _html() -> object:
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(F.lit("<!-- note --><div><dl><dt> Type </dt><dd> "), e("document_type"), F.lit(" </dd></dl><p>"), e("title"), F.lit('</p><style>p {}</style>A &amp; B<br/></div><div class="goal"><div class="name">'), e("committee_name"), F.lit("</div></div>"))


@query(f"""
    WITH h AS (SELECT id, {_HTML_SQL} AS html FROM document_records),
         t AS (SELECT id, replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '<[^>]*>', chr(1), 'g'), '&amp;', '&') AS x, html FROM h)
    SELECT id, trim(regexp_replace(replace(x, chr(1), ' '), '\\s+', ' ', 'g')) AS flat,
           array_to_string(list_filter(list_transform(string_split(x, chr(1)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), chr(10)) AS lines FROM t""")
def html_texts(s: SparkSession, d: str) -> DataFrame:
    h = _records(s, d).select("id", _html().alias("h"))
    return h.select("id", X.html_text(F.col("h")).alias("flat"), X.html_text(F.col("h"), "\n").alias("lines"))


@query("""
    SELECT id, coalesce(NULLIF(trim(document_type), ''), 'Information') AS kind, coalesce(NULLIF(trim(regexp_replace(committee_name, '\\s+', ' ', 'g')), ''), '-') AS goals FROM document_records""")
def html_definitions(s: SparkSession, d: str) -> DataFrame:
    h = _records(s, d).select("id", _html().alias("h"))
    return h.select("id", X.definition(F.col("h"), "Type", "Information").alias("kind"), F.coalesce(X.nonempty(F.array_join(X.goal_names(F.col("h")), ";")), F.lit("-")).alias("goals"))


@query("""
    SELECT segment_id, CASE WHEN CAST(floor(start_s) AS BIGINT) >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(start_s) AS BIGINT) // 3600, (CAST(floor(start_s) AS BIGINT) % 3600) // 60, CAST(floor(start_s) AS BIGINT) % 60)
        ELSE printf('%d:%02d', CAST(floor(start_s) AS BIGINT) // 60, CAST(floor(start_s) AS BIGINT) % 60) END AS at,
        CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 1.3) AS INT) AS by_words, CAST(length(text) // 4 AS INT) AS by_chars FROM (SELECT DISTINCT segment_id, start_s, text FROM segments)""")
def time_and_token_estimates(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "segments").select("segment_id", "start_s", "text").distinct()
    return g.select("segment_id", X.clock(F.col("start_s")).alias("at"), X.tokens_by_words(F.col("text")).alias("by_words"), X.tokens_by_chars(F.col("text")).alias("by_chars"))


@query("""
    SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s'']', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS plain,
           regexp_replace(replace(replace('\\--- ' || coalesce(title, '') || ' ---', '\\---', ''), '---', ''), '^\\s+|\\s+$', '', 'g') AS undashed,
           regexp_replace('postgres://u:' || id || '@h/db', '(://[^:/@\\s]+):[^@\\s]+@', '\\1:***@') AS dsn,
           CASE WHEN file_path LIKE '%.%' AND list_contains(['.pdf','.doc','.docx','.ppt','.pptx','.xls','.xlsx','.txt','.html'], lower(regexp_extract(file_path, '(\\.[^.]+)$', 1))) THEN lower(regexp_extract(file_path, '(\\.[^.]+)$', 1)) END AS ext
    FROM document_records""")
def text_cleaning(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    return r.select(
        "id", X.comparison_text(F.col("title")).alias("plain"), X.clean_dashes(F.concat(F.lit("\\--- "), F.coalesce("title", F.lit("")), F.lit(" ---"))).alias("undashed"),
        X.redact_dsn(F.concat(F.lit("postgres://u:"), "id", F.lit("@h/db"))).alias("dsn"), X.attachment_extension(F.col("file_path")).alias("ext"),
    )


@query("""
    SELECT query_id, chunk_id, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 9) AS p,
           CAST(least(greatest(coalesce(TRY_CAST(source_ranks['keyword'] AS INT), 0), 1), 25) AS INT) AS k
    FROM (SELECT DISTINCT query_id, chunk_id, source_scores['rerank'] AS x, source_ranks FROM fused_chunks) WHERE x IS NOT NULL AND NOT isnan(x)""")
def sigmoid_and_clamp(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "fused_chunks").select("query_id", "chunk_id", F.try_element_at("source_scores", F.lit("rerank")).alias("x"), F.try_element_at("source_ranks", F.lit("keyword")).alias("r")).distinct()
    f = f.where("x is not null and not isnan(x)")
    return f.select("query_id", "chunk_id", F.round(X.sigmoid(F.col("x")), 9).alias("p"), X.clamp(F.col("r"), 1, 25).alias("k"))


@query("""
    SELECT profile_id, CASE WHEN profile_id % 2 = 0 THEN array_to_string(list_filter(string_split_regex(name, '\\s+'), lambda x: x <> ''), ' ') ELSE 'when was ' || name || ' seen' END AS q
    FROM (SELECT DISTINCT profile_id, name FROM speaker_profiles)""")
def keyword_query_rewrite(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "speaker_profiles").select("profile_id", "name").distinct()
    q = F.concat(F.lit("when was "), "name", F.when(F.col("profile_id") % 2 == 0, " hired").otherwise(" seen"))
    return p.select("profile_id", X.keyword_query(q, F.array("name")).alias("q"))


@query("""
    SELECT profile_id, '{"a": ' || profile_id || '}' AS fenced, '{"b": 1}' AS last FROM (SELECT DISTINCT profile_id FROM speaker_profiles)""")
def json_blocks(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "speaker_profiles").select("profile_id").distinct()
    raw = F.concat(F.lit('x ```json\n{"a": '), F.col("profile_id").cast("string"), F.lit('}\n``` y {"b": 1} z'))
    return p.select("profile_id", X.fenced_json(raw).alias("fenced"), X.last_json_block(raw).alias("last"))


@query("""
    SELECT o_orderkey, '$' || format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS money, printf('%.1f%%', (o_orderkey % 1000) / 8.0 + 0.01) AS share FROM orders""")
def money_and_percent(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", X.dollars(F.col("o_totalprice")).alias("money"), X.percent((F.col("o_orderkey") % 1000) / 8.0 + 0.01).alias("share"))


@query()
def title_names(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "speaker_profiles").select("profile_id", "name").distinct()
    return p.select("profile_id", X.title_name(F.col("name")).alias("name"))
