"""Turns, their metrics and the dynamics of meetings, as windows and aggregates.

Windows are partitioned by meeting and slices of its time (SLICE_S); what a slice needs from the ones before it comes
from a table of slice edges, so a meeting with a third of all rows is many window partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.session import cut

SLICE_S = 600
_UP = Window.unboundedPreceding


def latest_rows(df: DataFrame, key: str, received: str) -> DataFrame:
    """Each key once, its latest received row; columns that are not used later are not shuffled either."""
    h = df.withColumn("__h", F.xxhash64(*df.columns))
    w = Window.partitionBy(key).orderBy(F.desc(received), "__h")
    return h.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__h")


def segments_of(df: DataFrame) -> DataFrame:
    """(segment_id, meeting_id, at, speaker, start_s, end_s, text, n_words, score_sum, score_n): each segment once, a null speaker as 'unknown'.

    score_sum and score_n are of the words' scores above 0. Segments without a start are left out; a null end is the start.
    Words and scores are counted before rows are shuffled, so that only their sums travel.
    """
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    good = F.filter(F.coalesce("words.score", F.array().cast("array<double>")), lambda x: x > 0)
    total = F.aggregate(good, F.lit(0.0), lambda a, x: a + x)
    own = df.select("segment_id", "meeting_id", "start_s", "end_s", "text", "speaker", "received_at", n.alias("n_words"), total.alias("score_sum"), F.size(good).alias("score_n"))
    s = latest_rows(own, "segment_id", "received_at").where("start_s is not null")
    return s.select("segment_id", "meeting_id", F.struct("start_s", "segment_id").alias("at"), F.coalesce("speaker", F.lit("unknown")).alias("speaker"), "start_s", F.coalesce("end_s", "start_s").alias("end_s"), "text", "n_words", "score_sum", "score_n")


def with_previous(df: DataFrame, group: str, at: str, time: Column, values: list[str], slice_s: float = SLICE_S) -> DataFrame:
    """df with `prev`: the struct of `values` of the row before in order of `at` (null for a group's first row).

    Give it narrow rows: they are shuffled by group and slice.
    """
    t = df.withColumn("__slice", F.floor(time / slice_s))
    tails = t.groupBy(group, "__slice").agg(F.max_by(F.struct(*values), at).alias("tail"))
    tails = tails.select(group, "__slice", F.lag("tail").over(Window.partitionBy(group).orderBy("__slice")).alias("__before"))
    w = Window.partitionBy(group, "__slice").orderBy(at)
    return t.join(tails, [group, "__slice"]).withColumn("prev", F.coalesce(F.lag(F.struct(*values)).over(w), F.col("__before"))).drop("__before")


def with_island(df: DataFrame, group: str, at: str, opens: Column, name: str = "island") -> DataFrame:
    """df (from with_previous) with the `at` of the row that opened its run."""
    w = Window.partitionBy(group, "__slice").orderBy(at).rowsBetween(_UP, 0)
    t = df.withColumn("__open", opens)
    own = t.groupBy(group, "__slice").agg(F.max(F.when(F.col("__open"), F.col(at))).alias("o"))
    carried = own.select(group, "__slice", F.last("o", ignorenulls=True).over(Window.partitionBy(group).orderBy("__slice").rowsBetween(_UP, -1)).alias("__carried"))
    t = t.withColumn(name, F.last(F.when(F.col("__open"), F.col(at)), ignorenulls=True).over(w)).join(carried, [group, "__slice"])
    return t.withColumn(name, F.coalesce(name, "__carried")).drop("__open", "__carried", "__slice", "prev")


_SUMS = ["n_words", "score_sum", "score_n"]


def turn_keys(seg: DataFrame, max_gap: float | None = 1.0, slice_s: float = SLICE_S) -> DataFrame:
    """(segment_id, meeting_id, speaker, at, end_s, turn, n_words, score_sum, score_n): turn is the segment that opens each segment's run of one speaker with gaps below max_gap."""
    narrow = cut(seg.select("segment_id", "meeting_id", "at", "start_s", "end_s", "speaker", *_SUMS))  # it is read again for the edges of slices
    p = with_previous(narrow, "meeting_id", "at", F.col("start_s"), ["speaker", "end_s"], slice_s)
    opens = F.col("prev").isNull() | (F.col("prev.speaker") != F.col("speaker"))
    if max_gap is not None:
        opens = opens | (F.round(F.col("start_s") - F.col("prev.end_s"), 6) >= max_gap)
    return with_island(p, "meeting_id", "at", opens, "turn").select("segment_id", "meeting_id", "speaker", "at", "end_s", "turn", *_SUMS)


def turns_of(keys: DataFrame, *more: Column) -> DataFrame:
    """Turns of turn_keys: (meeting_id, turn, speaker, start_s, end_s, n_words, n_segments, score_sum, score_n) and what `more` aggregates."""
    g = keys.groupBy("meeting_id", "turn").agg(
        F.first("speaker").alias("speaker"), F.max_by("end_s", "at").alias("end_s"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_segments"), F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"), *more
    )
    return g.withColumn("start_s", F.col("turn.start_s"))


def islands(seg: DataFrame, max_gap: float | None = 1.0, texts: bool = True) -> DataFrame:
    """Turns of segments_of: runs of one speaker with gaps below max_gap (None: any gap), with words, sums of scores and, if wanted, text.

    Turns are found and summed on narrow rows (partial before the shuffle); texts join them by segment only if they are asked for.
    """
    keys = turn_keys(seg, max_gap)
    if not texts:
        return turns_of(keys)
    t = seg.select("segment_id", "text").join(keys, "segment_id")
    g = turns_of(t, F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    return g.withColumn("text", F.array_join("p.text", " ")).drop("p")


def metrics(turns: DataFrame) -> DataFrame:
    """turns with wpm (0 without duration) and confidence (mean of scores above 0, else 0)."""
    dur = F.col("end_s") - F.col("start_s")
    return turns.withColumn("wpm", F.when(dur > 0, 60.0 * F.col("n_words") / dur).otherwise(0.0)).withColumn("confidence", F.coalesce(F.try_divide(F.col("score_sum"), F.col("score_n")), F.lit(0.0)))


def with_gaps(turns: DataFrame, rapid: float = 0.3) -> DataFrame:
    """turns with prev_speaker, latency, pause and overlap: a negative gap, or one below `rapid` at a change of speaker.

    Gaps are found on times and speakers, which are written once; every other column joins them by turn. Texts are never
    written on the way: they come from the turns' own aggregation, whose partitioning the join keeps.
    """
    narrow = ["meeting_id", "turn", "start_s", "end_s", "speaker"]
    turns = turns if "text" in turns.columns else cut(turns)
    p = with_previous(cut(turns.select(*narrow)) if "text" in turns.columns else turns.select(*narrow), "meeting_id", "turn", F.col("start_s"), ["speaker", "end_s"])
    rest = [c for c in turns.columns if c not in ("start_s", "end_s", "speaker")]
    if len(rest) > 2:
        p = turns.select(*rest).join(p.drop("__slice"), ["meeting_id", "turn"])
    gap = F.round(F.col("start_s") - F.col("prev.end_s"), 6)
    p = p.withColumn("prev_speaker", F.col("prev.speaker")).withColumn("latency", gap).drop("prev", "__slice")
    over = (F.col("latency") < 0) | ((F.col("latency") < rapid) & (F.col("prev_speaker") != F.col("speaker")))
    pause = F.when(F.col("latency").isNull(), F.col("start_s")).when(F.col("latency") < 0, 0.0).otherwise(F.col("latency"))
    return p.withColumn("overlap", F.coalesce(over, F.lit(False))).withColumn("pause", pause)


def speaker_turns(seg: DataFrame, max_gap: float | None = 1.0) -> DataFrame:
    """(meeting_id, turn, speaker, start_s, end_s) alone: what adjacency and gaps need; no text, word or score is shuffled."""
    return turns_of(turn_keys(seg, max_gap)).select("meeting_id", "turn", "speaker", "start_s", "end_s")


def turn_rows(seg: DataFrame, head: Callable[[], Column], max_gap: float | None = 1.0) -> DataFrame:
    """(meeting_id, at, turn, head, speaker, time_start, time_end, text): the segments of turns, each with its turn's measures shown by `head`.

    Everything about turns is worked out on narrow rows; a text is shuffled once to find its latest version and once by its user.
    """
    keys = cut(turn_keys(seg, max_gap))
    t = with_gaps(metrics(turns_of(keys)))
    t = t.select("meeting_id", "turn", head().alias("head"), F.col("start_s").alias("time_start"), F.col("end_s").alias("time_end"))
    rows = keys.select("segment_id", "meeting_id", "at", "turn", "speaker").join(t, ["meeting_id", "turn"])
    return rows.join(seg.select("segment_id", "text"), "segment_id").drop("segment_id")


#: Places to which a report rounds the measures.
PLACES = {"speaking_time_s": 1, "speaking_share_pct": 1, "mean_turn_length_words": 1, "mean_wpm": 1, "mean_confidence": 3, "mean_response_latency_s": 2}


def dynamics(turns: DataFrame, places: dict[str, int] | None = PLACES) -> DataFrame:
    """Per meeting and speaker: time, share, turns, words, means and interruptions, from with_gaps(metrics(islands)); None rounds nothing.

    A meeting's whole time is an aggregate joined back, so no window holds a meeting.
    """
    mine = turns.groupBy("meeting_id", "speaker").agg(
        F.sum(F.col("end_s") - F.col("start_s")).alias("speaking_time_s"), F.count("*").alias("turn_count"), F.sum("n_words").alias("total_words"), F.avg("wpm").alias("mean_wpm"),
        F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
        F.count_if(F.col("overlap") & (F.col("prev_speaker") != F.col("speaker"))).alias("interruptions_initiated"),
    )
    theirs = turns.where("prev_speaker <> speaker").groupBy("meeting_id", F.col("prev_speaker").alias("speaker")).agg(F.count_if("overlap").alias("interruptions_suffered"), F.avg("latency").alias("mean_response_latency_s"))
    j = mine.join(theirs, ["meeting_id", "speaker"], "left")
    whole = mine.groupBy("meeting_id").agg(F.sum("speaking_time_s").alias("whole"))
    j = j.join(whole, "meeting_id")
    out = {
        "speaking_time_s": F.col("speaking_time_s"), "speaking_share_pct": F.coalesce(F.try_divide(100 * F.col("speaking_time_s"), F.col("whole")), F.lit(0.0)), "turn_count": F.col("turn_count"), "total_words": F.col("total_words"),
        "mean_turn_length_words": F.col("total_words") / F.col("turn_count"), "mean_wpm": F.col("mean_wpm"), "mean_confidence": F.col("mean_confidence"),
        "interruptions_suffered": F.coalesce("interruptions_suffered", F.lit(0)), "interruptions_initiated": F.col("interruptions_initiated"), "mean_response_latency_s": F.col("mean_response_latency_s"),
    }
    return j.select("meeting_id", "speaker", *[(F.round(c, places[n]) if places and n in places else c).alias(n) for n, c in out.items()])


def adjacency(turns: DataFrame, least: int = 3, top: int | None = 30) -> DataFrame:
    """(meeting_id, from_speaker, to_speaker, n): who speaks after whom, `least` times or more, the `top` pairs of a meeting."""
    g = turns.where("prev_speaker <> speaker").groupBy("meeting_id", F.col("prev_speaker").alias("from_speaker"), F.col("speaker").alias("to_speaker")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if top is None:
        return g
    w = Window.partitionBy("meeting_id").orderBy(F.desc("n"), "from_speaker", "to_speaker")
    return g.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def degrees(edges: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """(speaker, out_degree, in_degree, degree, share) of weighted directed edges summed over meetings."""
    ends = edges.select(F.col(a).alias("speaker"), F.col(n).alias("o"), F.lit(0).cast("bigint").alias("i")).union(edges.select(b, F.lit(0).cast("bigint"), n))
    g = ends.groupBy("speaker").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    total = g.agg(F.sum("degree").alias("t"))
    return g.join(total).select("speaker", "out_degree", "in_degree", "degree", F.coalesce(F.try_divide("degree", "t"), F.lit(0.0)).alias("share"))


#: Letters by which a part is found in a longer text.
PART = 3


def canonical(labels: DataFrame, roster: DataFrame, label: str = "label") -> DataFrame:
    """(label, name): the first roster name (by pos) that equals the label, has it as a word, or is part of it or it of the name.

    All of these mean that one contains the other, in lower case and trimmed; a shared word alone does not link. A label without
    such a name, or a blank one, stays as it is. Whoever is contained has its first PART letters somewhere in the other,
    so both directions are equi-joins on such pieces, whatever the sizes.
    """
    low = lambda c: F.lower(F.trim(c))
    l = labels.select(label).distinct().withColumn("l", low(label))
    r = roster.select("name", "pos", low("name").alias("n")).where("n <> ''")
    head = lambda c: F.left(c, F.lit(PART)).alias("g")
    pieces = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(PART)), lambda k: F.substr(c, i, k)))))).alias("g")
    some = l.where("l <> ''")
    inside = some.select(label, "l", head(F.col("l"))).join(r.select("name", "pos", "n", pieces(F.col("n"))), "g").where(F.contains("n", "l"))
    around = some.select(label, "l", pieces(F.col("l"))).join(r.select("name", "pos", "n", head(F.col("n"))), "g").where(F.contains("l", "n"))
    best = inside.select(label, "name", "pos").union(around.select(label, "name", "pos")).groupBy(label).agg(F.min_by("name", "pos").alias("name"))
    return l.select(label).join(best, label, "left").select(label, F.coalesce("name", label).alias("name"))


def renumbered(df: DataFrame, group: str, label: str, at: str, prefix: str = "SPEAKER_") -> DataFrame:
    """(group, label, new_label): labels numbered by their first place."""
    g = df.groupBy(group, label).agg(F.min(at).alias("a"))
    n = F.row_number().over(Window.partitionBy(group).orderBy("a", label))
    return g.select(group, label, F.concat(F.lit(prefix), F.lpad(n.cast("string"), 2, "0")).alias("new_label"))


def longest_repeat(df: DataFrame, group: str, at: str, time: Column, value: Column) -> DataFrame:
    """(group, longest): the longest run of equal non-empty values; 1 if there is none."""
    v = df.withColumn("v", value)
    p = with_previous(v, group, at, time, ["v"])
    t = with_island(p, group, at, F.coalesce((F.col("prev.v") != F.col("v")) | (F.col("v") == ""), F.lit(True)), "run")
    return t.groupBy(group, "run").agg(F.count("*").alias("n")).groupBy(group).agg(F.max("n").alias("longest"))


def hallucination_flags(seg: DataFrame, durations: DataFrame) -> DataFrame:
    """(meeting_id, flags): signs of invented speech; durations: (meeting_id, duration_s), meetings without segments included."""
    key = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    runs = longest_repeat(seg, "meeting_id", "at", F.col("start_s"), key)
    texts = seg.select("meeting_id", key.alias("v")).where("v <> ''").groupBy("meeting_id", "v").agg(F.count("*").alias("n")).groupBy("meeting_id").agg(F.sum(F.col("n") - 1).alias("dup"), F.sum("n").alias("texts"))
    g = seg.groupBy("meeting_id").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.max("end_s").alias("last_end"))
    j = durations.join(g, "meeting_id", "left").join(runs, "meeting_id", "left").join(texts, "meeting_id", "left")
    minutes = F.col("duration_s") / 60
    some = F.coalesce(F.col("n"), F.lit(0)) > 0
    flags = F.array_compact(
        F.array(
            F.when(~some & (F.col("duration_s") > 30), "no_segments"), F.when(some & (minutes > 1) & (F.col("words") / minutes < 20), "low_word_density"),
            F.when((F.col("n") >= 3) & (F.col("longest") >= 3), "repeated_segments"), F.when((F.col("n") >= 5) & (F.col("dup") / F.col("texts") > 0.3), "high_duplicate_ratio"),
            F.when(F.col("last_end") > F.col("duration_s") + 1, "timestamp_overflow"),
        )
    )
    return j.select("meeting_id", F.array_join(flags, ",").alias("flags"))


def summary(seg: DataFrame) -> DataFrame:
    return seg.groupBy("meeting_id").agg(F.sum("n_words").alias("word_count"), F.count_distinct("speaker").alias("speaker_count"), F.count("*").alias("segment_count"), F.max("end_s").alias("duration_s"))
