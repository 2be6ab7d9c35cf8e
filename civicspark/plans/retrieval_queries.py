"""Queries of hybrid retrieval over chunks and embeddings."""

from __future__ import annotations

import datetime
import os
import urllib.parse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import retrieval as R
from civicspark.operators import textindex as TI
from civicspark.session import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TODAY = datetime.date(2026, 1, 1)
QUESTIONS = [(1, "budget analyst committee"), (2, "the district restroom"), (3, "capacity near Foxglen"), (4, "union delegate warranty"), (5, "before the vote")]
_QUESTIONS_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS) + ") q(query_id, text)"
_STOP = "[" + ", ".join(f"'{w}'" for w in R.STOPWORDS) + "]"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "tenant_id", "document_type", "content", F.col("metadata.title").alias("title"), F.to_date(F.try_to_timestamp("metadata.meeting_date")).alias("meeting_date")).dropDuplicates(["chunk_id"])


def _rows(s: SparkSession, d: str) -> DataFrame:
    """Chunks as stored, repeated rows included: for uses to which they make no difference, without shuffling any text."""
    return table(s, d, "chunks").select(F.col("id").alias("chunk_id"), "content", F.to_date(F.try_to_timestamp("metadata.meeting_date")).alias("meeting_date"))


def _questions(s: SparkSession) -> DataFrame:
    return s.createDataFrame(QUESTIONS, "query_id int, text string")


def _terms_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), '([\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}])', ' \\1 ', 'g'), ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x))"


_INDEXES: dict[tuple, TI.TextIndex] = {}


def _index(s: SparkSession, d: str, stem: bool = False) -> TI.TextIndex:
    """The stored index of a folder's chunks, built at its first use in an application; changed files are indexed anew."""
    files = tuple(sorted((f, os.path.getmtime(f.removeprefix("file://"))) if os.path.exists(f.removeprefix("file://")) else (f, 0.0) for f in map(urllib.parse.unquote, table(s, d, "chunks").inputFiles())))
    key = (s.sparkContext.applicationId, d, stem, files)
    if key not in _INDEXES:
        _INDEXES[key] = _built(s, d, stem)
    return _INDEXES[key]


def _built(s: SparkSession, d: str, stem: bool = False) -> TI.TextIndex:
    c = table(s, d, "chunks").select(F.col("id").alias("chunk_id"), "content")  # repeated rows change nothing
    return TI.build(c, "chunk_id", "content", f"{shared_dir(s)}/index-{uuid.uuid4().hex}", terms=R.stemmed_terms if stem else R.terms)


@query("WITH t AS (SELECT chunk_id, unnest(ts) AS term FROM (SELECT id AS chunk_id, " + _terms_sql("content") + " AS ts FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1)) SELECT count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT term, chunk_id, count(*) AS tf FROM t GROUP BY ALL)")
def index_build(s: SparkSession, d: str) -> DataFrame:
    """A new index of all chunks, and what it holds."""
    p = s.read.parquet(f"{_built(s, d).path}/terms").groupBy("term", "chunk_id").agg(F.count_distinct("pos").alias("tf"))
    return p.agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("occurrences"))


_TEXT = f"""c AS (SELECT id AS chunk_id, content, tenant_id, document_type, metadata.title AS title, TRY_CAST(metadata.meeting_date AS DATE) AS meeting_date FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1),
    o AS (SELECT chunk_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos, len(ts) AS dl FROM (SELECT chunk_id, {_terms_sql("content")} AS ts FROM c)),
    q AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS qat, len(ts) AS n_terms FROM (SELECT query_id, {_terms_sql("text")} AS ts FROM {_QUESTIONS_SQL})),
    m AS (SELECT query_id, chunk_id, count(*) AS tf, count(DISTINCT term) AS found, max(n_terms) AS n FROM q JOIN o USING (term) GROUP BY ALL HAVING count(DISTINCT term) = max(n_terms))"""


@query(f"WITH {_TEXT} SELECT query_id, chunk_id, tf FROM m")
def fts_and(s: SparkSession, d: str) -> DataFrame:
    return R.match_all(_index(s, d).postings(_questions(s)), _questions(s), "chunk_id")


_STEM = "list_transform({}, lambda x: CASE WHEN length(x) <= 3 THEN x WHEN regexp_matches(x, 'ies$') AND NOT regexp_matches(x, '[ea]ies$') THEN left(x, length(x) - 3) || 'y' WHEN regexp_matches(x, 'es$') AND NOT regexp_matches(x, '[aeo]es$') THEN left(x, length(x) - 1) WHEN regexp_matches(x, 's$') AND NOT regexp_matches(x, '(us|ss)$') THEN left(x, length(x) - 1) ELSE x END)"


@query(f"WITH {_TEXT.replace(_terms_sql('content'), _STEM.format(_terms_sql('content'))).replace(_terms_sql('text'), _STEM.format(_terms_sql('text')))} SELECT query_id, chunk_id, tf FROM m")
def fts_stemmed(s: SparkSession, d: str) -> DataFrame:
    return R.match_all(_index(s, d, True).postings(_questions(s)), _questions(s), "chunk_id", R.stemmed_terms)


@query(f"WITH {_TEXT}, p AS (SELECT query_id, chunk_id, pos - qat AS st, count(*) AS f, max(n_terms) AS n FROM q JOIN o USING (term) GROUP BY ALL) SELECT query_id, chunk_id, count(*) AS hits FROM p WHERE f = n GROUP BY ALL")
def fts_phrase(s: SparkSession, d: str) -> DataFrame:
    return R.match_phrase(_index(s, d).postings(_questions(s)), _questions(s), "chunk_id")


@query(f"""
    WITH {_TEXT}, l AS (SELECT c.chunk_id, coalesce(n, 0) AS dl FROM c LEFT JOIN (SELECT chunk_id, count(*) AS n FROM o GROUP BY 1) USING (chunk_id)), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
         t AS (SELECT chunk_id, term, count(*) AS tf FROM o GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
    SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM (SELECT DISTINCT query_id, term FROM q) JOIN t USING (term) JOIN f USING (term) JOIN l USING (chunk_id), st GROUP BY ALL""")
def fts_bm25(s: SparkSession, d: str) -> DataFrame:
    i = _index(s, d)
    return R.bm25(i.postings(_questions(s)), i.lengths(), _questions(s), "chunk_id").withColumn("score", F.round("score", 6))


@query(f"""
    WITH {_TEXT}, h AS (SELECT DISTINCT q.query_id, m.chunk_id, q.term, o.pos FROM q JOIN m USING (query_id) JOIN o ON o.term = q.term AND o.chunk_id = m.chunk_id),
         e AS (SELECT h.query_id, h.chunk_id, h.pos, min(l) AS low, count(*) AS have FROM h JOIN (SELECT a.query_id, a.chunk_id, a.pos, b.term, max(b.pos) AS l FROM h a JOIN h b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL) x USING (query_id, chunk_id, pos) GROUP BY ALL),
         w AS (SELECT query_id, chunk_id, low, min(pos) AS pos FROM e WHERE have = (SELECT max(n_terms) FROM q WHERE q.query_id = e.query_id) GROUP BY ALL)
    SELECT query_id, chunk_id, round(sum(0.1 / (pos - low + 1)), 6) AS score FROM w GROUP BY ALL""")
def fts_cover_density(s: SparkSession, d: str) -> DataFrame:
    return R.cover_density(_index(s, d).postings(_questions(s)), _questions(s), "chunk_id").withColumn("score", F.round("score", 6))


NAMES = [(1, "Foxglen"), (1, "Upperfold"), (2, "Room B27"), (3, "oxgle"), (4, "pperfold, ")]
_NAMES_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in NAMES) + ") v(query_id, name)"


@query(f"""
    WITH {_TEXT}, r AS (SELECT query_id, name, chunk_id, row_number() OVER (PARTITION BY query_id, name ORDER BY meeting_date DESC NULLS LAST, chunk_id) AS rn FROM {_NAMES_SQL} JOIN c ON contains(lower(content), lower(name)))
    SELECT DISTINCT query_id, chunk_id, 1.0::DOUBLE AS score FROM r WHERE rn <= 20""")
def name_leg(s: SparkSession, d: str) -> DataFrame:
    return R.name_hits(_rows(s, d), s.createDataFrame(NAMES, "query_id int, name string"), "chunk_id", "content", "meeting_date", 20)


_COS = "round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda z: z * z))) * sqrt(list_sum(list_transform(CAST(b.embedding AS DOUBLE[]), lambda z: z * z)))), 6)"


def _vector_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"SELECT query_id, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS.replace(', 6)', ', 9)')} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5")
def knn_cosine(s: SparkSession, d: str) -> DataFrame:
    return R.knn(table(s, d, "embeddings"), _vector_queries(s, d), 5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS.replace(', 6)', ', 9)')} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label IN (1, 2, 3)) WHERE rank <= 5")
def knn_filtered(s: SparkSession, d: str) -> DataFrame:
    """The filter comes before the cut to k, so no over-fetching is needed."""
    return R.knn(table(s, d, "embeddings").where("label in (1, 2, 3)"), _vector_queries(s, d), 5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s9 DESC, vec_id) AS r2 FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, b.label, {_COS} AS score, {_COS.replace(', 6)', ', 9)')} AS s9, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS.replace(', 6)', ', 9)')} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 15 AND label IN (1, 2, 3)) WHERE r2 <= 5")
def knn_compat_overfetch(s: SparkSession, d: str) -> DataFrame:
    """Compatibility: three times k are fetched, filtered afterwards and cut; may return fewer than k."""
    e = table(s, d, "embeddings")
    wide = R.knn(e, _vector_queries(s, d), 15).drop("rank").join(e.where("label in (1, 2, 3)").select("vec_id"), "vec_id", "left_semi")
    return R.top_k(wide, 5, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64) GROUP BY ALL) SELECT label, CAST(i - 1 AS INT) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) + 0.0 AS x FROM m")
def mean_pool(s: SparkSession, d: str) -> DataFrame:
    v = R.mean_pool(table(s, d, "embeddings"), "label", "embedding", 64)
    return v.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", (F.round("x", 6) + 0.0).alias("x"))


_LEGS = f"""{_TEXT}, k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY tf DESC, chunk_id) AS rank FROM m),
    n AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, name, chunk_id, row_number() OVER (PARTITION BY query_id, name ORDER BY meeting_date DESC NULLS LAST, chunk_id) AS rn FROM {_NAMES_SQL} JOIN c ON contains(lower(content), lower(name))) WHERE rn <= 20),
    n2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM n),
    f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf, count(*) AS legs FROM (SELECT * FROM k UNION ALL SELECT * FROM n2) GROUP BY ALL),
    z AS (SELECT f.*, c.title, c.meeting_date, c.content, rrf * (1 + 0.3 * CASE WHEN c.meeting_date IS NULL THEN 0.5 WHEN c.meeting_date > DATE '2026-01-01' THEN 1.0 ELSE pow(0.5, (DATE '2026-01-01' - c.meeting_date) / 365.0) END) AS score FROM f JOIN c USING (chunk_id))"""


_LEGS3 = _LEGS.replace("    f AS (", f"""    qv AS (SELECT query_id, embedding FROM {_QUESTIONS_SQL.replace(") q(", ") u(")} JOIN embeddings ON vec_id = query_id), vs AS (SELECT a.query_id, b.vec_id, {_COS.replace(", 6)", ", 9)")} AS s FROM qv a, embeddings b),
    cv AS (SELECT chunk_id, CAST('0x' || left(md5(chunk_id), 8) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id FROM c),
    v2 AS (SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM vs JOIN cv USING (vec_id)) WHERE rank <= 20),
    f AS (""").replace("UNION ALL SELECT * FROM n2)", "UNION ALL SELECT * FROM n2 UNION ALL SELECT query_id, chunk_id, rank FROM v2)")


def _chunk_vectors(s: SparkSession, d: str) -> DataFrame:
    """(chunk_id, embedding): the test data has no vectors of chunks, so each takes one of the table's by the hash of its id."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n"))
    c = table(s, d, "chunks").select(F.col("id").alias("chunk_id")).distinct()
    at = F.conv(F.left(F.md5("chunk_id"), F.lit(8)), 16, 10).cast("bigint") % F.col("n")
    return c.join(n).select("chunk_id", at.alias("vec_id")).join(e, "vec_id").select("chunk_id", "embedding")


def _vector_leg(s: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    q = table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding").join(questions.select("query_id"), "query_id", "left_semi")
    return R.knn(_chunk_vectors(s, d), q, 20, "chunk_id").select("query_id", "chunk_id", "score")


def _fused(s: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    c = _rows(s, d)
    keyword = R.match_all(_index(s, d).postings(_questions(s)), _questions(s), "chunk_id").withColumnRenamed("tf", "score")
    names = R.name_hits(c, s.createDataFrame(NAMES, "query_id int, name string"), "chunk_id", "content", "meeting_date", 20)
    return R.fuse({"keyword": keyword, "name": names} | ({"vector": _vector_leg(s, d, _questions(s))} if vectors else {}), "chunk_id")


@query(f"WITH {_LEGS} SELECT query_id, chunk_id, round(rrf, 9) AS rrf_score, legs FROM f")
def rrf_2leg(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.size("source_ranks").cast("bigint").alias("legs"))


@query(f"WITH {_LEGS3} SELECT query_id, chunk_id, round(rrf, 9) AS rrf_score, legs FROM f")
def rrf_3leg(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d, True).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.size("source_ranks").cast("bigint").alias("legs"))


@query("""
    WITH l AS (SELECT DISTINCT query_id, chunk_id, unnest(map_entries(source_ranks)) AS e FROM fused_chunks) SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS rrf_score FROM (SELECT DISTINCT query_id, chunk_id, e.key AS k, e.value AS r FROM l) GROUP BY ALL""")
def rrf_rebuild(s: SparkSession, d: str) -> DataFrame:
    """rrf_score of stored ranks, computed anew."""
    l = table(s, d, "fused_chunks").select("query_id", "chunk_id", F.explode("source_ranks").alias("k", "r")).distinct()
    return l.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (60 + F.col("r"))), 9).alias("rrf_score"))


@query(f"WITH {_LEGS3} SELECT query_id, chunk_id, round(score, 8) AS score FROM z")
def recency_boost(s: SparkSession, d: str) -> DataFrame:
    h = R.with_recency(_fused(s, d, True).join(_chunks(s, d).select("chunk_id", "meeting_date"), "chunk_id"), "meeting_date", TODAY)
    return h.select("query_id", "chunk_id", F.round("score", 8).alias("score"))


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    fused = _fused(s, d, True).join(_chunks(s, d).select("chunk_id", "title", "meeting_date", "document_type", "content"), "chunk_id")
    return R.with_recency(fused, "meeting_date", TODAY)


@query(f"WITH {_LEGS3} SELECT query_id, source_number, chunk_id, title, meeting_date, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS source_number FROM z) WHERE source_number <= 10")
def hybrid_citations(s: SparkSession, d: str) -> DataFrame:
    """The flagship: keyword, name and vector legs, fusion, recency, ten citations per question."""
    top = R.top_k(_hybrid(s, d), 10, "chunk_id")
    return R.citations(top, "chunk_id").select("query_id", "source_number", "chunk_id", "title", "meeting_date", "score")


@query(f"""
    WITH {_LEGS3}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM z) WHERE rn <= 20),
         x AS (SELECT p.query_id, p.chunk_id, len(list_intersect(list_distinct({_terms_sql("v.text")}), list_distinct({_terms_sql("p.content")}))) / len(list_distinct({_terms_sql("v.text")})) AS s FROM p JOIN {_QUESTIONS_SQL.replace(") q(", ") v(")} USING (query_id))
    SELECT query_id, chunk_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM x) WHERE r <= 10""")
def rerank_pool(s: SparkSession, d: str) -> DataFrame:
    h = _hybrid(s, d).join(_questions(s), "query_id")
    return R.rescore(h, "text", "content", "chunk_id", 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_LEGS3}, t AS (SELECT chunk_id, max(score) AS score FROM z GROUP BY 1) SELECT chunk_id, round(score, 8) AS score FROM t ORDER BY t.score DESC, chunk_id LIMIT 15")
def multi_query_union(s: SparkSession, d: str) -> DataFrame:
    """Hits of several sub-queries, each chunk once, sorted anew."""
    t = _hybrid(s, d).groupBy("chunk_id").agg(F.max("score").alias("score"))
    return t.orderBy(F.desc("score"), "chunk_id").limit(15).select("chunk_id", F.round("score", 8).alias("score"))


@query(f"""
    WITH {_LEGS3}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS i FROM z) WHERE i <= 3)
    SELECT query_id, string_agg('[Source ' || i || ']' || CASE WHEN title <> '' THEN chr(10) || 'Title: ' || title ELSE '' END || CASE WHEN meeting_date IS NOT NULL THEN chr(10) || 'Date: ' || CAST(meeting_date AS VARCHAR) ELSE '' END
           || CASE WHEN metadata.committee_name <> '' THEN chr(10) || 'Committee: ' || metadata.committee_name ELSE '' END || CASE WHEN metadata.source_url <> '' THEN chr(10) || 'URL: ' || metadata.source_url ELSE '' END || chr(10) || chr(10) || coalesce(t.content, ''),
           chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context
    FROM t JOIN (SELECT id AS chunk_id, metadata FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1) USING (chunk_id) GROUP BY 1""")
def context_block(s: SparkSession, d: str) -> DataFrame:
    top = R.citations(R.top_k(_hybrid(s, d), 3, "chunk_id"), "chunk_id")
    more = table(s, d, "chunks").dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), F.col("metadata.committee_name").alias("committee"), F.col("metadata.source_url").alias("url"))
    return R.context_blocks(top.join(more, "chunk_id"), "title", "meeting_date", "content", "committee", "url")


@query(f"WITH {_LEGS3} SELECT query_id, chunk_id, round(z.score * CASE d.document_type WHEN 'agenda' THEN 1.2 WHEN 'transcript' THEN 0.7 ELSE 1.0 END, 8) AS score FROM z JOIN c d USING (chunk_id)")
def authority_weight(s: SparkSession, d: str) -> DataFrame:
    h = R.with_authority(_hybrid(s, d), "document_type", {"agenda": 1.2, "transcript": 0.7})
    return h.select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query("""
    SELECT id, CASE WHEN regexp_matches(q, '\\b(how many|count|number of|list all|total)\\b') AND regexp_matches(q, '\\b(why|how did|explain|discuss)') THEN 'hybrid' WHEN regexp_matches(q, '\\b(how many|count|number of|list all|total)\\b') THEN 'database' ELSE 'rag' END AS route
    FROM (SELECT id, lower(CASE length(title) % 3 WHEN 0 THEN 'How many times ' WHEN 1 THEN 'Explain the total of ' ELSE 'What about ' END || title) AS q FROM document_records WHERE title IS NOT NULL)""")
def question_route(s: SparkSession, d: str) -> DataFrame:
    k = F.length("title") % 3
    q = F.concat(F.when(k == 0, "How many times ").when(k == 1, "Explain the total of ").otherwise("What about "), "title")
    return table(s, d, "document_records").where("title is not null").select("id", R.route(q).alias("route"))


@query(f"""
    WITH {_LEGS3}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS i FROM z) WHERE i <= 3)
    SELECT query_id, string_agg(string_split(regexp_replace(regexp_replace(content, '^\\s+', ''), '([.!?])\\s+', '\\1' || chr(1)), chr(1))[1] || ' [Source ' || i || ']', ' ' ORDER BY i) AS answer FROM t GROUP BY 1""")
def extractive_answers(s: SparkSession, d: str) -> DataFrame:
    return R.extractive_answer(R.citations(R.top_k(_hybrid(s, d), 3, "chunk_id"), "chunk_id"), "content")


_BATCH = "(SELECT query_id, text FROM (SELECT title AS text, row_number() OVER (ORDER BY md5(title), title) AS query_id FROM (SELECT DISTINCT title FROM document_records WHERE title <> '')) WHERE query_id <= 100)"


@query(f"""
    WITH {_TEXT.replace(_QUESTIONS_SQL, _BATCH).replace("FROM (SELECT query_id, " + _terms_sql("text"), "FROM (SELECT query_id, list_distinct(" + _terms_sql("text") + ")")}, k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY tf DESC, chunk_id) AS rank FROM m),
         vs AS (SELECT a.query_id, b.vec_id, {_COS.replace(", 6)", ", 9)")} AS s FROM (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id BETWEEN 1 AND 100 AND vec_id IN (SELECT query_id FROM {_BATCH})) a, embeddings b),
         cv AS (SELECT chunk_id, CAST('0x' || left(md5(chunk_id), 8) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id FROM c),
         v2 AS (SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM vs JOIN cv USING (vec_id)) WHERE rank <= 20),
         f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT * FROM k UNION ALL SELECT * FROM v2) GROUP BY ALL)
    SELECT query_id, chunk_id, round(rrf, 9) AS rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, chunk_id) AS r FROM f) WHERE r <= 10""")
def hybrid_batch(s: SparkSession, d: str) -> DataFrame:
    """A hundred questions at once (titles of records): stored index and vectors, fused, ten chunks each."""
    t = table(s, d, "document_records").where("title <> ''").select(F.col("title").alias("text")).distinct().orderBy(F.md5("text"), "text").limit(100)
    q = s.createDataFrame([(i, r[0]) for i, r in enumerate(t.collect(), 1)], "query_id bigint, text string")
    keyword = R.match_all(_index(s, d).postings(q), q, "chunk_id").withColumnRenamed("tf", "score")
    fused = R.fuse({"keyword": keyword, "vector": _vector_leg(s, d, q)}, "chunk_id").withColumn("score", F.round("rrf_score", 9))
    return R.top_k(fused, 10, "chunk_id").select("query_id", "chunk_id", F.col("score").alias("rrf_score"))


@query()
def api_ask(s: SparkSession, d: str) -> DataFrame:
    """All three legs through the library's entry point."""
    from civicspark.api import Records

    c = _chunks(s, d)
    names = s.createDataFrame(NAMES, "query_id int, name string")
    return Records(table(s, d, "document_records"), c).ask(_questions(s), "tn-00000", names=names, today=TODAY)
