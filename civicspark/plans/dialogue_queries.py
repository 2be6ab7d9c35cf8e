"""Queries of turns and meeting dynamics. Speakers are labels as written; resolving them is a separate step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import dialogue as D
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


def _segments(s: SparkSession, d: str) -> DataFrame:
    return D.segments_of(table(s, d, "segments"))


def _turns(s: SparkSession, d: str) -> DataFrame:
    return D.with_gaps(D.metrics(D.islands(_segments(s, d), texts=False)))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return D.with_gaps(D.speaker_turns(_segments(s, d)))


_T = """g AS (SELECT segment_id, meeting_id, coalesce(speaker, 'unknown') AS speaker, start_s, end_s, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_words, list_transform(words, lambda w: w.score) AS scores
         FROM segments QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY received_at DESC) = 1),
     b AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker OR round(start_s - lag(end_s) OVER w, 6) >= 1.0 THEN 1 ELSE 0 END AS opens FROM g WINDOW w AS (PARTITION BY meeting_id ORDER BY start_s, segment_id)),
     i AS (SELECT *, sum(opens) OVER (PARTITION BY meeting_id ORDER BY start_s, segment_id) AS turn FROM b),
     t AS (SELECT meeting_id, turn, any_value(speaker) AS speaker, min(start_s) AS start_s, arg_max(end_s, (start_s, segment_id)) AS end_s, string_agg(text, ' ' ORDER BY start_s, segment_id) AS text, CAST(sum(n_words) AS BIGINT) AS n_words, count(*) AS n_segments,
                  list_filter(flatten(list(scores) FILTER (scores IS NOT NULL)), lambda x: x > 0) AS good, min(segment_id) AS k FROM i GROUP BY ALL),
     m AS (SELECT *, CASE WHEN end_s > start_s THEN 60.0 * n_words / (end_s - start_s) ELSE 0 END AS wpm, coalesce(list_avg(good), 0) AS confidence, lag(speaker) OVER w AS prev_speaker, round(start_s - lag(end_s) OVER w, 6) AS latency FROM t WINDOW w AS (PARTITION BY meeting_id ORDER BY turn)),
     x AS (SELECT *, coalesce(latency < 0 OR (latency < 0.3 AND prev_speaker <> speaker), false) AS overlap, CASE WHEN latency IS NULL THEN start_s WHEN latency < 0 THEN 0 ELSE latency END AS pause FROM m)"""


@query(f"WITH {_T} SELECT meeting_id, speaker, start_s, end_s, text, n_words, n_segments FROM t")
def turns_islands(s: SparkSession, d: str) -> DataFrame:
    return D.islands(_segments(s, d)).select("meeting_id", "speaker", "start_s", "end_s", "text", "n_words", "n_segments")


@query(f"WITH {_T.replace(' OR round(start_s - lag(end_s) OVER w, 6) >= 1.0', '')} SELECT meeting_id, speaker, start_s, n_segments FROM t")
def utterances_by_speaker(s: SparkSession, d: str) -> DataFrame:
    return D.islands(_segments(s, d), None, texts=False).select("meeting_id", "speaker", "start_s", "n_segments")


@query(f"WITH {_T} SELECT meeting_id, start_s, speaker, prev_speaker, latency, round(pause, 6) AS pause, overlap FROM x")
def turn_gaps(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("meeting_id", "start_s", "speaker", "prev_speaker", "latency", F.round("pause", 6).alias("pause"), "overlap")


@query(f"WITH {_T} SELECT meeting_id, start_s, round(wpm, 4) AS wpm, round(confidence, 6) AS confidence FROM x")
def turn_metrics(s: SparkSession, d: str) -> DataFrame:
    return _turns(s, d).select("meeting_id", "start_s", F.round("wpm", 4).alias("wpm"), F.round("confidence", 6).alias("confidence"))


@query(f"""
    WITH {_T}, a AS (SELECT meeting_id, speaker, sum(end_s - start_s) AS st, count(*) AS turn_count, CAST(sum(n_words) AS BIGINT) AS total_words, avg(wpm) AS mw, count(*) FILTER (overlap AND prev_speaker <> speaker) AS interruptions_initiated FROM x GROUP BY ALL),
         z AS (SELECT meeting_id, prev_speaker AS speaker, count(*) FILTER (overlap) AS suffered, avg(latency) AS lat FROM x WHERE prev_speaker <> speaker GROUP BY ALL)
    SELECT meeting_id, speaker, turn_count, total_words, interruptions_initiated, coalesce(suffered, 0) AS interruptions_suffered, round(mw, 0) AS mean_wpm, round(100 * st / sum(st) OVER (PARTITION BY meeting_id), 0) AS share FROM a LEFT JOIN z USING (meeting_id, speaker)""")
def speaker_dynamics_counts(s: SparkSession, d: str) -> DataFrame:
    x = D.dynamics(_turns(s, d), None)
    return x.select("meeting_id", "speaker", "turn_count", "total_words", "interruptions_initiated", "interruptions_suffered", F.round("mean_wpm", 0).alias("mean_wpm"), F.round("speaking_share_pct", 0).alias("share"))


@query(f"""
    WITH {_T}, a AS (SELECT meeting_id, speaker, sum(end_s - start_s) AS st, count(*) AS turn_count, CAST(sum(n_words) AS BIGINT) AS total_words, avg(wpm) AS mw, coalesce(avg(confidence) FILTER (confidence > 0), 0) AS mc, count(*) FILTER (overlap AND prev_speaker <> speaker) AS interruptions_initiated FROM x GROUP BY ALL),
         z AS (SELECT meeting_id, prev_speaker AS speaker, count(*) FILTER (overlap) AS suffered, avg(latency) AS lat FROM x WHERE prev_speaker <> speaker GROUP BY ALL)
    SELECT meeting_id, speaker, round(st, 8) AS speaking_time_s, round(coalesce(100 * st / NULLIF(sum(st) OVER (PARTITION BY meeting_id), 0), 0), 8) AS speaking_share_pct, turn_count, total_words, round(total_words / turn_count, 8) AS mean_turn_length_words, round(mw, 8) AS mean_wpm,
           round(mc, 8) AS mean_confidence, coalesce(suffered, 0) AS interruptions_suffered, interruptions_initiated, round(lat, 8) AS mean_response_latency_s FROM a LEFT JOIN z USING (meeting_id, speaker)""")
def speaker_dynamics(s: SparkSession, d: str) -> DataFrame:
    """All measures, to more places than a report shows."""
    x = D.dynamics(_turns(s, d), None)
    return x.select(*[F.round(c, 8).alias(c) if c in D.PLACES else c for c in x.columns])


_ADJ = "adj AS (SELECT meeting_id, prev_speaker AS from_speaker, speaker AS to_speaker, count(*) AS n FROM x WHERE prev_speaker <> speaker GROUP BY ALL HAVING count(*) >= 3)"


@query(f"WITH {_T}, {_ADJ} SELECT meeting_id, from_speaker, to_speaker, n FROM adj QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, from_speaker, to_speaker) <= 30")
def adjacency_pairs(s: SparkSession, d: str) -> DataFrame:
    return D.adjacency(_pairs(s, d))


@query(f"""
    WITH {_T}, {_ADJ}, e AS (SELECT from_speaker, to_speaker, sum(n) AS n FROM adj GROUP BY ALL), u AS (SELECT from_speaker AS speaker, n AS o, 0 AS i FROM e UNION ALL SELECT to_speaker, 0, n FROM e),
         gd AS (SELECT speaker, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM u GROUP BY 1)
    SELECT *, round(degree / sum(degree) OVER (), 9) AS share FROM gd""")
def network_degree(s: SparkSession, d: str) -> DataFrame:
    e = D.adjacency(_pairs(s, d), top=None).groupBy("from_speaker", "to_speaker").agg(F.sum("n").alias("n"))
    return D.degrees(e, "from_speaker", "to_speaker", "n").withColumn("share", F.round("share", 9))


@query("SELECT coalesce(speaker, 'unknown') AS speaker, count(DISTINCT meeting_id) AS meetings FROM segments GROUP BY 1")
def meetings_per_speaker(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).groupBy("speaker").agg(F.count_distinct("meeting_id").alias("meetings"))


_ROSTER = ["Grettasby", "Kwame Grettasby", "Foxglen", "Isabella", "Trustee"]
_ROSTER_SQL = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_ROSTER)) + ") r(pos, name)"


@query(f"""
    WITH l AS (SELECT DISTINCT name AS label, lower(trim(name)) AS l FROM speaker_profiles),
         m AS (SELECT label, r.name, pos FROM l, {_ROSTER_SQL} WHERE l <> '' AND (l = lower(r.name) OR list_contains(string_split(lower(r.name), ' '), l) OR contains(l, lower(r.name)) OR contains(lower(r.name), l)))
    SELECT l.label, coalesce(arg_min(m.name, m.pos), l.label) AS name FROM l LEFT JOIN m USING (label) GROUP BY 1""")
def canonical_names(s: SparkSession, d: str) -> DataFrame:
    roster = s.createDataFrame(list(enumerate(_ROSTER)), "pos int, name string")
    return D.canonical(table(s, d, "speaker_profiles").select(F.col("name").alias("label")), roster)


@query("""
    WITH g AS (SELECT meeting_id, coalesce(speaker, 'unknown') AS speaker, min((start_s, segment_id)) AS a FROM segments GROUP BY ALL)
    SELECT meeting_id, speaker, 'SPEAKER_' || lpad(CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY a, speaker) AS VARCHAR), 2, '0') AS new_label FROM g""")
def label_renumbering(s: SparkSession, d: str) -> DataFrame:
    return D.renumbered(_segments(s, d), "meeting_id", "speaker", "at")


_E = "e AS (SELECT user_id, event_id, ts, event_type FROM events), b AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)"


@query(f"WITH {_E} SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1")
def run_lengths(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "ts", "event_type")
    return D.longest_repeat(e, "user_id", "at", F.unix_timestamp(F.col("ts").cast("timestamp")) / 144, F.col("event_type"))


@query(f"""
    WITH {_T.split('b AS')[0].rstrip(' ,').rstrip().rstrip(',')}, k AS (SELECT *, lower(trim(text)) AS v FROM g), dur AS (SELECT DISTINCT meeting_id, 400.0 AS duration_s FROM meetings),
         r0 AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY meeting_id ORDER BY start_s, segment_id) IS DISTINCT FROM v OR v = '' THEN 1 ELSE 0 END AS o FROM k), r1 AS (SELECT *, sum(o) OVER (PARTITION BY meeting_id ORDER BY start_s, segment_id) AS run FROM r0),
         r2 AS (SELECT meeting_id, max(n) AS longest FROM (SELECT meeting_id, run, count(*) AS n FROM r1 GROUP BY ALL) GROUP BY 1), d2 AS (SELECT meeting_id, sum(n - 1) AS dup, sum(n) AS texts FROM (SELECT meeting_id, v, count(*) AS n FROM k WHERE v <> '' GROUP BY ALL) GROUP BY 1),
         a AS (SELECT meeting_id, count(*) AS n, sum(n_words) AS words, max(end_s) AS last_end FROM k GROUP BY 1)
    SELECT meeting_id, array_to_string(list_filter([CASE WHEN n IS NULL AND duration_s > 30 THEN 'no_segments' END, CASE WHEN n > 0 AND words / (duration_s / 60) < 20 THEN 'low_word_density' END, CASE WHEN n >= 3 AND longest >= 3 THEN 'repeated_segments' END,
        CASE WHEN n >= 5 AND dup / texts > 0.3 THEN 'high_duplicate_ratio' END, CASE WHEN last_end > duration_s + 1 THEN 'timestamp_overflow' END], lambda x: x IS NOT NULL), ',') AS flags
    FROM dur LEFT JOIN a USING (meeting_id) LEFT JOIN r2 USING (meeting_id) LEFT JOIN d2 USING (meeting_id)""")
def hallucination_flags(s: SparkSession, d: str) -> DataFrame:
    durations = table(s, d, "meetings").select("meeting_id", F.lit(400.0).alias("duration_s")).distinct()
    return D.hallucination_flags(_segments(s, d), durations)


@query("""
    SELECT meeting_id, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS word_count, count(DISTINCT coalesce(speaker, 'unknown')) AS speaker_count, count(*) AS segment_count, max(end_s) AS duration_s
    FROM (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY segment_id) = 1) GROUP BY 1""")
def transcript_summary(s: SparkSession, d: str) -> DataFrame:
    return D.summary(_segments(s, d))


@query("""
    SELECT meeting_id, round(max(n) / min(n), 6) AS ratio, max(n) > 1.2 * min(n) AS uneven FROM (SELECT meeting_id, segment_id % 2 AS vendor, sum(length(text)) AS n FROM (SELECT DISTINCT meeting_id, segment_id, text FROM segments) GROUP BY ALL) GROUP BY 1""")
def vendor_coverage(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "segments").select("meeting_id", "segment_id", "text").distinct().groupBy("meeting_id", F.col("segment_id") % 2).agg(F.sum(F.length("text")).alias("n"))
    return v.groupBy("meeting_id").agg(F.round(F.max("n") / F.min("n"), 6).alias("ratio"), (F.max("n") > 1.2 * F.min("n")).alias("uneven"))
