"""Queries of the chunkers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import text as X
from civicspark.operators import chunking
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


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_records").select("id", "content_text")


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({_STRIP.format('content_text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"


@query(f"SELECT id, len(ss) AS n, ss[1] AS first, ss[-1] AS last FROM (SELECT id, {_SENTENCES} AS ss FROM document_records WHERE content_text IS NOT NULL)")
def sentences(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).where("content_text is not null").select("id", chunking.sentences(F.col("content_text")).alias("ss"))
    return t.select("id", F.size("ss").alias("n"), F.get("ss", F.lit(0)).alias("first"), F.get("ss", F.size("ss") - 1).alias("last"))


@query()
def chunk_sentences(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_texts(_texts(s, d), "id", "content_text", chunking.pack_sentences)


@query()
def chunk_paragraph_chars(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_texts(_texts(s, d), "id", "content_text", chunking.pack_paragraphs)


def _utterances(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "segments").dropDuplicates(["segment_id"]).select("meeting_id", "segment_id", F.coalesce("speaker", F.lit("?")).alias("speaker"), "start_s", "end_s", "text")


@query("""
    WITH RECURSIVE u AS (SELECT meeting_id, coalesce(speaker, '?') AS speaker, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n, row_number() OVER (PARTITION BY meeting_id ORDER BY start_s, segment_id) AS i
                FROM (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY segment_id) = 1)),
         r AS (SELECT meeting_id, i, n AS used, 0 AS chunk_index, n AS words FROM u WHERE i = 1
               UNION ALL SELECT u.meeting_id, u.i, CASE WHEN r.used + u.n > 150 THEN u.n ELSE r.used + u.n END, CASE WHEN r.used + u.n > 150 THEN r.chunk_index + 1 ELSE r.chunk_index END, u.n FROM r JOIN u ON u.meeting_id = r.meeting_id AND u.i = r.i + 1)
    SELECT r.meeting_id, CAST(r.chunk_index AS INT) AS chunk_index, string_agg('[' || u.speaker || ']: ' || u.text, chr(10) ORDER BY u.i) AS content FROM r JOIN u USING (meeting_id, i) GROUP BY ALL""")
def chunk_words_150(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_utterances(_utterances(s, d), "meeting_id", ["start_s", "segment_id"], "words")


@query()
def chunk_speaker_150(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_utterances(_utterances(s, d), "meeting_id", ["start_s", "segment_id"], "speaker")


@query()
def chunk_turns(s: SparkSession, d: str) -> DataFrame:
    from civicspark.operators import dialogue

    head = lambda: X.turn_line(F.col("speaker"), F.col("start_s"), F.col("end_s"), F.col("wpm"), F.col("confidence"), F.col("overlap"), F.col("pause"), F.lit(""))
    return chunking.chunk_turn_rows(dialogue.turn_rows(dialogue.segments_of(table(s, d, "segments")), head), "meeting_id")


@query("""
    SELECT n_name AS nation, 'Customers of ' || n_name || chr(10) || string_agg(c_mktsegment || ': ' || n, chr(10) ORDER BY c_mktsegment) AS content
    FROM (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1""")
def render_rows(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation"), "c_mktsegment").agg(F.count("*").alias("n"))
    return chunking.render_rows(c, ["nation"], [F.col("c_mktsegment")], F.concat(F.lit("Customers of "), "nation"), F.concat("c_mktsegment", F.lit(": "), F.col("n").cast("string")))
