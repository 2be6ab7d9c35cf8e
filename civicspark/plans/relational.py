"""Queries of the relational operators: scans, predicates, joins, paging and set operations."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.operators import relational as R
from civicspark.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_records")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks without the rows repeated for an id."""
    return table(s, d, "chunks").dropDuplicates(["id"])


CHUNKS_SQL = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1)"


@query(f"""
    SELECT r.id, r.title, r.document_type, r.meeting_date, coalesce(n, 0) AS n_chunks
    FROM document_records r LEFT JOIN (SELECT document_id AS id, count(*) AS n FROM {CHUNKS_SQL} GROUP BY 1) c USING (id)
    ORDER BY r.meeting_date DESC NULLS LAST, r.title NULLS LAST, r.id LIMIT 50 OFFSET 20""")
def doc_list_page(s: SparkSession, d: str) -> DataFrame:
    listed = R.page(_records(s, d).select("id", "title", "document_type", "meeting_date"), [F.desc_nulls_last("meeting_date"), F.asc_nulls_last("title"), F.col("id")], 50, 20)
    return R.with_child_count(listed, _chunks(s, d), "id", "document_id", "n_chunks")


@query("SELECT tenant_id, count(*) AS total, count(DISTINCT meeting_date) AS meetings FROM document_records WHERE document_type = 'agenda' GROUP BY 1")
def doc_list_total(s: SparkSession, d: str) -> DataFrame:
    return R.where_given(_records(s, d), document_type="agenda", committee_name=None).groupBy("tenant_id").agg(F.count("*").alias("total"), F.count_distinct("meeting_date").alias("meetings"))


@query(f"SELECT r.id, r.processing_status, count(c.id) AS n_chunks FROM document_records r LEFT JOIN {CHUNKS_SQL} c ON c.document_id = r.id GROUP BY ALL")
def doc_detail_chunk_count(s: SparkSession, d: str) -> DataFrame:
    return R.with_child_count(_records(s, d).select("id", "processing_status"), _chunks(s, d), "id", "document_id", "n_chunks")


@query("SELECT id, tenant_id, document_type, meeting_date FROM document_records WHERE processing_status = 'pending'")
def pending_documents(s: SparkSession, d: str) -> DataFrame:
    return R.where_given(_records(s, d), processing_status="pending", document_type=None).select("id", "tenant_id", "document_type", "meeting_date")


@query(f"""
    SELECT c.id, c.document_id, c.chunk_index, r.title FROM {CHUNKS_SQL} c JOIN document_records r ON r.id = c.document_id WHERE r.processing_status = 'complete' AND c.token_count IS NULL""")
def pending_chunks(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).where("processing_status = 'complete'").select(F.col("id").alias("document_id"), "title")
    return _chunks(s, d).where("token_count is null").join(r, "document_id").select("id", "document_id", "chunk_index", "title")


@query("SELECT vec_id, label FROM embeddings")
def scroll_payload(s: SparkSession, d: str) -> DataFrame:
    """The whole vector table without reading a vector."""
    return table(s, d, "embeddings").select("vec_id", "label")


@query("SELECT id, document_type FROM document_records WHERE document_type NOT IN ('research_analysis', 'email') OR document_type IS NULL")
def exclude_types(s: SparkSession, d: str) -> DataFrame:
    return R.excluding(_records(s, d), "document_type", ["research_analysis", "email"]).select("id", "document_type")


@query("SELECT id, title FROM document_records WHERE tenant_id = 'tn-00000' AND contains(lower(title), lower('Forecast'))")
def ilike_search(s: SparkSession, d: str) -> DataFrame:
    return R.tenant(_records(s, d), "tn-00000").where(R.containing(F.col("title"), "Forecast")).select("id", "title")


@query("SELECT id, file_path FROM document_records WHERE file_path LIKE '/records/tn-00000/%' OR file_path LIKE '%.docx'")
def like_paths(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).where(F.col("file_path").startswith("/records/tn-00000/") | F.col("file_path").like("%.docx")).select("id", "file_path")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-09 12:00:00'")
def activity_changes_range(s: SparkSession, d: str) -> DataFrame:
    e = R.between(table(s, d, "events"), "ts", datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 9, 12))
    return e.select("event_id", "user_id", "event_type")


#: The fields that every vector payload must have.
PAYLOAD = ["chunk_id", "document_id", "tenant_id", "content", "document_type", "meeting_date", "committee_name", "meeting_id", "agenda_item_id", "title", "source_url", "chunk_index", "token_count", "contains_table"]


@query(f"""
    SELECT id AS chunk_id, document_id, tenant_id, content, document_type, metadata.meeting_date AS meeting_date, metadata.committee_name AS committee_name, metadata.meeting_id AS meeting_id,
           metadata.agenda_item_id AS agenda_item_id, metadata.title AS title, metadata.source_url AS source_url, chunk_index, token_count, coalesce(contains_table, false) AS contains_table FROM {CHUNKS_SQL}""")
def payload_projection(s: SparkSession, d: str) -> DataFrame:
    m = lambda k: F.col(f"metadata.{k}").alias(k)
    out = _chunks(s, d).select(
        F.col("id").alias("chunk_id"), "document_id", "tenant_id", "content", "document_type", m("meeting_date"), m("committee_name"), m("meeting_id"), m("agenda_item_id"), m("title"), m("source_url"),
        "chunk_index", "token_count", F.coalesce("contains_table", F.lit(False)).alias("contains_table"),
    )
    if missing := set(PAYLOAD) - set(out.columns):
        raise ValueError(f"payload lacks {sorted(missing)}")
    return out


@query(f"""
    SELECT id, array_to_string(list_sort(list_filter([CASE WHEN metadata.title <> '' THEN 'title=' || metadata.title END, CASE WHEN metadata.meeting_id <> '' THEN 'meeting_id=' || metadata.meeting_id END,
           CASE WHEN metadata.agenda_item_id <> '' THEN 'agenda_item_id=' || metadata.agenda_item_id END], lambda x: x IS NOT NULL)), '|') AS sparse FROM {CHUNKS_SQL}""")
def sparse_metadata(s: SparkSession, d: str) -> DataFrame:
    keys = ("title", "meeting_id", "agenda_item_id")
    m = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(f"metadata.{k}"))]), lambda k, v: v.isNotNull() & (v != ""))
    return _chunks(s, d).select("id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("sparse"))


@query("SELECT id, coalesce(NULLIF(agenda_item_id, ''), NULLIF(meeting_id, ''), id) AS key, coalesce(meeting_date, CAST(created_at AS DATE)) AS day FROM document_records")
def coalesce_chains(s: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.nullif(F.col(c), F.lit(""))
    return _records(s, d).select("id", F.coalesce(e("agenda_item_id"), e("meeting_id"), F.col("id")).alias("key"), F.coalesce("meeting_date", F.to_date("created_at")).alias("day"))


@query("SELECT p_partkey, p_type FROM part WHERE NOT starts_with(p_type, 'STANDARD') AND regexp_matches(p_type, 'ECONOMY|PROMO')")
def prefix_filters(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").where(~F.col("p_type").startswith("STANDARD") & F.col("p_type").rlike("ECONOMY|PROMO")).select("p_partkey", "p_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def row_cap(s: SparkSession, d: str) -> DataFrame:
    """A result capped for display; TakeOrderedAndProject keeps 50 rows per task."""
    return R.page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50)


@query("""
    WITH g AS (SELECT DISTINCT segment_id, meeting_id, start_s, text FROM segments),
         n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_s, segment_id) AS rn FROM g),
         v AS (SELECT meeting_id, segment_id, row_number() OVER (PARTITION BY meeting_id ORDER BY rn) AS vn FROM n WHERE rn > 150 AND regexp_matches(lower(text), 'motion|second|aye|approve'))
    SELECT meeting_id, segment_id FROM n WHERE rn <= 150 UNION ALL SELECT meeting_id, segment_id FROM v WHERE vn <= 50""")
def keyword_segments(s: SparkSession, d: str) -> DataFrame:
    """The first 150 segments of a meeting and up to 50 later ones that mention a vote.

    Both cuts are limited windows, which every task applies before the shuffle, so no meeting is numbered whole.
    """
    g = table(s, d, "segments").select("segment_id", "meeting_id", F.struct("start_s", "segment_id").alias("at"), "text").distinct()
    w = Window.partitionBy("meeting_id").orderBy("at")
    first = cut(g.select("segment_id", "meeting_id", "at").withColumn("rn", F.row_number().over(w)).where("rn <= 150"))
    last = first.groupBy("meeting_id").agg(F.max("at").alias("__last"))
    votes = g.where(F.lower("text").rlike("motion|second|aye|approve")).join(last, "meeting_id").where(F.col("at") > F.col("__last"))
    votes = votes.withColumn("vn", F.row_number().over(w)).where("vn <= 50")
    return first.select("meeting_id", "segment_id").union(votes.select("meeting_id", "segment_id"))


@query(f"""
    SELECT c.id, r.title, r.meeting_date FROM {CHUNKS_SQL} c JOIN document_records r ON c.document_id = r.id WHERE r.tenant_id = 'tn-00001' AND contains(lower(c.content), 'budget')""")
def chunk_document_join(s: SparkSession, d: str) -> DataFrame:
    r = R.tenant(_records(s, d), "tn-00001").select(F.col("id").alias("document_id"), "title", "meeting_date")
    return _chunks(s, d).where(R.containing(F.col("content"), "budget")).select("id", "document_id").join(r, "document_id").select("id", "title", "meeting_date")


@query("""
    WITH c AS (SELECT meeting_id, scraped_at, unnest(categories) AS c FROM meetings), i AS (SELECT meeting_id, scraped_at, c.category_id AS cid, unnest(c.items) AS it FROM c),
         l AS (SELECT meeting_id, c.category_id AS cid, max_by(c.category_name, scraped_at) AS category_name FROM c WHERE c.category_id IS NOT NULL AND c.category_name IS NOT NULL GROUP BY ALL)
    SELECT DISTINCT i.meeting_id, i.cid AS category_id, i.it.item_id AS item_id, l.category_name FROM i LEFT JOIN l ON i.meeting_id = l.meeting_id AND i.cid = l.cid WHERE i.it.item_id IS NOT NULL""")
def item_category_lookup(s: SparkSession, d: str) -> DataFrame:
    """Items with the latest name of their category."""
    from civicspark.operators import nested

    m = table(s, d, "meetings").select("meeting_id", "scraped_at", "categories")
    cats = nested.categories_table(m, ["meeting_id", "scraped_at"]).where("category_id is not null and category_name is not null")
    names = cats.groupBy("meeting_id", "category_id").agg(F.max_by("category_name", "scraped_at").alias("category_name"))
    items = nested.items_table(m, ["meeting_id", "scraped_at"]).where("item_id is not null").select("meeting_id", "category_id", "item_id").distinct()
    return items.join(names, ["meeting_id", "category_id"], "left")


ROSTER = [("2015-01-01", "2019-12-31", "board A", 1), ("2019-07-01", "2021-06-30", "board B", 2), ("2021-07-01", "2023-12-31", "board C", 3)]
_ROSTER_SQL = "(VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}', '{n}', {p})" for a, b, n, p in ROSTER) + ") r(s, e, board, p)"


@query(f"""
    WITH m AS (SELECT DISTINCT meeting_id, meeting_date FROM meetings WHERE meeting_date IS NOT NULL)
    SELECT meeting_id, meeting_date, coalesce((SELECT board FROM {_ROSTER_SQL} WHERE m.meeting_date BETWEEN s AND e ORDER BY p LIMIT 1), 'board C') AS board FROM m""")
def roster_interval_join(s: SparkSession, d: str) -> DataFrame:
    roster = s.createDataFrame([(a, b, n, p) for a, b, n, p in ROSTER], "start string, end string, board string, priority int").withColumns({c: F.to_date(c) for c in ("start", "end")})
    m = table(s, d, "meetings").select("meeting_id", "meeting_date").where("meeting_date is not null").distinct()
    return R.by_interval(m, "meeting_date", roster).select("meeting_id", "meeting_date", "board")


@query("""
    SELECT m.meeting_date, m.meeting_id FROM (SELECT meeting_date, max(meeting_id) AS meeting_id FROM meetings GROUP BY 1) m
    JOIN (SELECT DISTINCT meeting_date FROM document_records WHERE document_type = 'transcript') t USING (meeting_date)""")
def dates_in_both(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "meetings").groupBy("meeting_date").agg(F.max("meeting_id").alias("meeting_id"))
    return m.join(_records(s, d).where("document_type = 'transcript'").select("meeting_date").distinct(), "meeting_date")


@query("SELECT DISTINCT r.meeting_id FROM document_records r WHERE meeting_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.meeting_id = r.meeting_id)")
def anti_new_items(s: SparkSession, d: str) -> DataFrame:
    return R.unseen(_records(s, d).where("meeting_id is not null").select("meeting_id").distinct(), table(s, d, "segments"), ["meeting_id"])


@query("""
    SELECT DISTINCT id FROM document_records r WHERE meeting_id IN (SELECT meeting_id FROM segments) OR id IN (SELECT document_id FROM document_pages) OR agenda_item_id IN (SELECT agenda_item_id FROM document_records WHERE document_type = 'agenda_item')""")
def semi_already_ingested(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).select("id", "meeting_id", "agenda_item_id", "document_type")
    return R.seen_by_any(r, [("meeting_id", table(s, d, "segments"), "meeting_id"), ("id", table(s, d, "document_pages"), "document_id"), ("agenda_item_id", r.where("document_type = 'agenda_item'"), "agenda_item_id")], "id")


@query("""
    SELECT f.query_id, f.chunk_id, p.m AS element FROM (SELECT query_id, chunk_id, coalesce(CAST(source_ranks['keyword'] AS INT), 0) AS pos FROM (SELECT DISTINCT query_id, chunk_id, source_ranks FROM fused_chunks)) f
    JOIN (SELECT profile_id AS query_id, unnest(mean_wpm) AS m, generate_subscripts(mean_wpm, 1) - 1 AS pos FROM (SELECT DISTINCT profile_id, mean_wpm FROM speaker_profiles)) p USING (query_id, pos)""")
def claims_by_position(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "fused_chunks").select("query_id", "chunk_id", F.try_element_at("source_ranks", F.lit("keyword")).alias("pos")).distinct()
    p = table(s, d, "speaker_profiles").select(F.col("profile_id").alias("query_id"), "mean_wpm").distinct()
    return R.by_position(p, "mean_wpm", f, ["query_id"], "pos").select("query_id", "chunk_id", "element")


def _aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    j = R.range_join(a.select("segment_id", "meeting_id", F.col("start_s").alias("t")), b.select("meeting_id", "start_s", "text"), ["meeting_id"], "start_s", F.col("t") - 5, F.col("t") + 30, 35.0)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "text"))), lambda x: x["text"]), " ")
    return j.groupBy("segment_id").agg(F.count("*").alias("n"), joined.alias("text"))


@query("""
    WITH g AS (SELECT DISTINCT segment_id, meeting_id, start_s, text FROM segments)
    SELECT a.segment_id, count(*) AS n, string_agg(b.text, ' ' ORDER BY b.start_s, b.text) AS text FROM g a JOIN g b ON a.meeting_id = b.meeting_id AND b.start_s >= a.start_s - 5 AND b.start_s <= a.start_s + 30 GROUP BY 1""")
def window_align_join(s: SparkSession, d: str) -> DataFrame:
    """Text of the meeting from 5 s before to 30 s after the start of every segment, both included, its own too."""
    g = table(s, d, "segments").select("segment_id", "meeting_id", "start_s", "text").distinct()
    return _aligned(g, g)


@query(f"SELECT c.id, c.document_id FROM {CHUNKS_SQL} c WHERE document_id IN (SELECT document_id FROM (SELECT document_id, max(rrf_score) AS m FROM fused_chunks GROUP BY 1) ORDER BY m DESC NULLS LAST, document_id LIMIT 20)")
def scope_semi(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the twenty best documents."""
    top = R.page(table(s, d, "fused_chunks").groupBy("document_id").agg(F.max("rrf_score").alias("m")), [F.desc_nulls_last("m"), F.col("document_id")], 20)
    # NaN is the greatest value in both engines
    return _chunks(s, d).select("id", "document_id").join(top, "document_id", "left_semi")


@query("""
    WITH o AS (SELECT id AS key, coalesce(page_count, 0) AS size_bytes, processing_status AS status, ocr_method AS worker_id FROM document_records),
         n AS (SELECT id AS key, coalesce(page_count, 0) + CASE WHEN length(id) % 2 = 0 AND has_tables THEN 1 ELSE 0 END AS size_bytes FROM document_records UNION ALL SELECT DISTINCT document_id || '-new', 7 FROM document_pages)
    SELECT n.key, n.size_bytes, CASE WHEN o.size_bytes = n.size_bytes AND o.status <> 'pending' THEN o.status ELSE 'pending' END AS status,
           CASE WHEN o.size_bytes = n.size_bytes AND o.status <> 'pending' THEN o.worker_id END AS worker_id FROM n LEFT JOIN o USING (key)""")
def manifest_merge(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    size = F.coalesce("page_count", F.lit(0))
    old = r.select(F.col("id").alias("key"), size.alias("size_bytes"), F.col("processing_status").alias("status"), F.col("ocr_method").alias("worker_id"))
    new = r.select(F.col("id").alias("key"), (size + F.when((F.length("id") % 2 == 0) & F.col("has_tables"), 1).otherwise(0)).alias("size_bytes"))
    new = new.union(table(s, d, "document_pages").select(F.concat("document_id", F.lit("-new")), F.lit(7)).distinct())
    return R.merge_manifest(old, new)


@query("SELECT processing_status AS status, count(*) AS n FROM document_records GROUP BY 1")
def manifest_histogram(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).groupBy(F.col("processing_status").alias("status")).agg(F.count("*").alias("n"))


TEMPLATES = {"agenda": "What was on the agenda?", "email": "Who wrote about it?", "transcript": "Who said it?"}


@query("SELECT id, CASE document_type WHEN 'agenda' THEN 'What was on the agenda?' WHEN 'email' THEN 'Who wrote about it?' WHEN 'transcript' THEN 'Who said it?' ELSE 'What is known?' END AS question FROM document_records")
def template_lookup(s: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])
    return _records(s, d).select("id", F.coalesce(F.try_element_at(m, F.coalesce("document_type", F.lit(""))), F.lit("What is known?")).alias("question"))


@query("""
    WITH l AS (SELECT meeting_id, unnest(map_entries(speaker_map)) AS e, CAST(scraped_at AS VARCHAR) AS backend FROM meetings WHERE speaker_map IS NOT NULL)
    SELECT meeting_id || ' ' || e.key AS label, count(DISTINCT backend) AS backends, array_to_string(list_sort(list(DISTINCT e.value)), '; ') AS answers,
           CASE WHEN count(DISTINCT e.value) <= 1 THEN 'CONSENSUS' ELSE 'DISAGREEMENT' END AS verdict FROM l GROUP BY 1""")
def mapping_consensus(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "meetings").where("speaker_map is not null").select("meeting_id", "scraped_at", F.explode("speaker_map").alias("k", "v"))
    return R.consensus(l.select(F.concat_ws(" ", "meeting_id", "k").alias("label"), "v", "scraped_at"), "label", "v", "scraped_at")


@query("""
    SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL AS brand FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_brand FROM part""")
def union_missing_cols(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    u = table(s, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    p = table(s, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return R.stacked([c, u, p])


@query("SELECT meeting_date FROM meetings INTERSECT SELECT meeting_date FROM documents")
def intersect_dates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "meetings").select("meeting_date").intersect(table(s, d, "documents").select("meeting_date"))


@query("SELECT source FROM documents WHERE source IS NOT NULL EXCEPT SELECT source FROM mix_targets WHERE max_repeats > 2")
def except_payload(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("source is not null").select("source").subtract(table(s, d, "mix_targets").where("max_repeats > 2").select("source"))


@query("SELECT DISTINCT meeting_id, title FROM document_records WHERE document_type IN ('agenda', 'agenda_item') UNION SELECT meeting_id, name FROM meetings")
def distinct_union(s: SparkSession, d: str) -> DataFrame:
    a = _records(s, d).where(F.col("document_type").isin("agenda", "agenda_item")).select("meeting_id", "title")
    return a.union(table(s, d, "meetings").select("meeting_id", "name")).distinct()


@query("""
    SELECT o_orderpriority AS priority, coalesce(NULLIF(list_position(['2-HIGH','1-URGENT','5-LOW'], o_orderpriority), 0), 99) AS place, count(*) AS n FROM orders GROUP BY ALL""")
def custom_order(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return o.withColumn("place", R.in_order(F.col("priority"), ["2-HIGH", "1-URGENT", "5-LOW"]))


@query("SELECT id, (row_number() OVER (ORDER BY created_at, id) - 1) % 7 AS part FROM document_records")
def round_robin_parts(s: SparkSession, d: str) -> DataFrame:
    return R.round_robin(_records(s, d).select("id", "created_at"), [F.col("created_at"), F.col("id")], 7).select("id", "part")


@query("""
    SELECT user_id AS session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1""")
def activity_sessions_rollup(s: SparkSession, d: str) -> DataFrame:
    types = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(s, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), types.alias("types"))


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def activity_sessions(s: SparkSession, d: str) -> DataFrame:
    """The latest event of each session."""
    return R.latest(table(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""
    SELECT user_id FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 10""")
def last_sessions(s: SparkSession, d: str) -> DataFrame:
    """The ten most recent sessions, by their latest event."""
    return R.page(table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("t")), [F.desc("t"), F.col("user_id")], 10).select("user_id")


@query("""
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INT) >= 50""")
def json_props(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return e.where("k >= 50")


@query("""
    SELECT r.r_name, n.n_name, grouping_id(r.r_name, n.n_name) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)""")
def rollup_demo(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_demo(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT id AS key FROM document_records r WHERE processing_status = 'complete' AND file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM document_pages p WHERE p.document_id = r.id)")
def manifest_pull(s: SparkSession, d: str) -> DataFrame:
    """Finished entries with a file that is not here yet."""
    r = _records(s, d).where("processing_status = 'complete' and file_path is not null").select(F.col("id").alias("key"))
    return R.unseen(r, table(s, d, "document_pages").select(F.col("document_id").alias("key")), ["key"])


@query("""
    SELECT CASE WHEN document_type = 'agenda_item' THEN 'html' WHEN coalesce(file_path, '') = '' THEN 'error' WHEN regexp_matches(lower(file_path), '\\.(pptx|ppsx)$') THEN 'native' WHEN regexp_matches(lower(file_path), '\\.(doc|docx|xls|xlsx|ppt)$') THEN 'office' ELSE 'ocr' END AS route, count(*) AS n
    FROM document_records GROUP BY 1""")
def extraction_routes(s: SparkSession, d: str) -> DataFrame:
    from civicspark.sources.meetings import extraction_route

    return _records(s, d).groupBy(extraction_route(F.coalesce("document_type", F.lit("")), F.col("file_path")).alias("route")).agg(F.count("*").alias("n"))


@query("""
    WITH i AS (SELECT meeting_id, files_found, unnest(c.items) AS it FROM (SELECT meeting_id, files_found, unnest(categories) AS c FROM meetings)),
         s AS (SELECT DISTINCT meeting_id FROM i WHERE it.item_id IS NOT NULL), f AS (SELECT DISTINCT meeting_id FROM meetings WHERE files_found > 1), m AS (SELECT DISTINCT meeting_id FROM meetings)
    SELECT CASE WHEN meeting_id IN (SELECT meeting_id FROM s) THEN 'structured' WHEN meeting_id IN (SELECT meeting_id FROM f) THEN 'flat' ELSE 'empty' END AS format, count(*) AS n FROM m GROUP BY 1""")
def format_report(s: SparkSession, d: str) -> DataFrame:
    """Directories as their files tell: a listing made of each meeting's items (directories of their own) and found files."""
    from civicspark.operators import nested
    from civicspark.sources import meetings as M

    m = table(s, d, "meetings")
    own = m.select(F.col("meeting_id").alias("meeting_dir"), F.lit(None).cast("string").alias("sub_dir"), F.lit("meeting.json").alias("name"))
    found = m.where("files_found > 1").select("meeting_id", F.lit(None).cast("string"), F.lit("agenda.txt"))
    items = nested.items_table(m.select("meeting_id", "categories"), ["meeting_id"]).where("item_id is not null").select("meeting_id", "item_id", F.lit("item.json"))
    return M.format_report(own.union(found).union(items))


@query("""
    SELECT CAST(created_at AS DATE) AS day, count(*) AS n, round(count(*) / 1440.0, 6) AS per_minute FROM document_records GROUP BY 1""")
def run_throughput(s: SparkSession, d: str) -> DataFrame:
    """Records per day and minute of a run."""
    g = _records(s, d).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return g.withColumn("per_minute", F.round(F.col("n") / 1440, 6))


@query("SELECT extraction_method AS source, count(*) AS n, round(avg(processing_time_ms), 6) AS mean_ms FROM document_pages GROUP BY 1")
def extraction_latency(s: SparkSession, d: str) -> DataFrame:
    from civicspark.operators import corpus

    return corpus.service_stats(table(s, d, "document_pages"), "extraction_method", "processing_time_ms").withColumn("mean_ms", F.round("mean_ms", 6))


@query("""
    WITH r AS (SELECT count(*) AS n, count(*) / (date_diff('microsecond', min(updated_at), max(updated_at)) / 60e6) AS per_minute FROM document_records WHERE processing_status = 'complete'), l AS (SELECT count(*) AS k FROM document_records WHERE processing_status = 'pending')
    SELECT n, round(per_minute, 9) AS per_minute, round(k / per_minute, 3) AS eta_minutes FROM r, l""")
def run_eta(s: SparkSession, d: str) -> DataFrame:
    """Rate of the finished records and how long the pending ones will take at it."""
    from civicspark.operators import corpus

    r = _records(s, d)
    left = r.where("processing_status = 'pending'").agg(F.count("*").alias("left"))
    t = corpus.throughput(r.where("processing_status = 'complete'"), "updated_at", 1).join(left)
    return t.select("n", F.round("per_minute", 9).alias("per_minute"), F.round(F.col("left") * F.col("eta_minutes"), 3).alias("eta_minutes"))


@query()
def sample_records(s: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 20 records (the sampling operator: order by a hash, keep n)."""
    return R.page(_records(s, d).select("id", F.xxhash64("id", F.lit(7)).alias("h")), [F.col("h"), F.col("id")], 20).select("id")
