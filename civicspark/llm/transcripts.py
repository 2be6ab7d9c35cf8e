"""Speech segments into clean, ordered speaker turns.

One Aho-Corasick automaton per worker finds labels, hesitations and words of annotations in each text in a single
pass. Context rules decide what a match means (a label only at the head of a text, an annotation only inside its
brackets, "you know" only where it is not part of a clause), and the intervals that remain are subtracted from
the text. Turns are runs of one speaker with short gaps; they are built by windows over time slices of a
meeting whose edges are then joined, so that no meeting has to fit into one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.operators.dialogue import latest_rows, with_island, with_previous
from civicspark.session import cut

#: Hesitations, and set phrases that are hesitations only outside a clause.
HESITATIONS = ("uh", "um", "er", "erm", "ah", "eh", "hm", "hmm", "mm", "mhm", "mm-hmm", "uh-huh", "uhm", "huh")
PHRASES = ("you know", "i mean")
#: Words that mark a bracketed span as an annotation.
SOUNDS = (
    "applause", "background", "beep", "breath", "chatter", "cheer", "clap", "cough", "cross talk", "crosstalk", "door", "foreign", "gavel", "inaudible", "indiscernible", "laugh",
    "mumbl", "music", "noise", "pause", "phone", "recess", "ring", "sigh", "silence", "sneez", "sound", "static", "unintelligible",
)
#: The words that speaker labels start with.
LABELS = ("speaker", "spkr", "spk", "s")
#: Seconds of a meeting in one slice of the windows.
SLICE_S = 600
MAX_GAP_S = 1.0

_UNKNOWN = re.compile(r"\W*(?:unk|unknown|none|null|n/?a)?\W*", re.I)
_STAMP = re.compile(r"[\[(]\s*\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\s*[\])]")
_CUE = re.compile(r"[\s>]*(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d+)?(?:\s*(?:-->|–|—|-|to)\s*(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d+)?|(?=\s*(?:[-–—:>]|$)))")
_LABEL = re.compile(r"(?:speaker|spkr|spk|s)\s*[._\-#]?\s*(\d{1,4})", re.I)
_NAME = re.compile(r"(?:>>\s*)?([^\W\d_][^:\[\]()<>{}*\n]{1,60}?)\s*:\s+")
_OPEN = {"[": "]", "{": "}", "<": ">", "(": ")"}
_CLAUSE_BEFORE = re.compile(r"(?:\b(?:do|does|did|don't|didn't|if|as|would|could|can|may|might|should|let|what|that is what))\s*$", re.I)
_CLAUSE_AFTER = re.compile(r"\s*(?:that|what|how|who|why|when|where|if)\b", re.I)


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("hesitation", HESITATIONS), ("phrase", PHRASES), ("sound", SOUNDS), ("label", LABELS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _spans(text: str) -> list[tuple[int, int, str]]:
    """Bracketed spans (start, end, opening mark), nested ones with their outermost bounds."""
    out, stack = [], []
    for i, c in enumerate(text):
        if c in _OPEN:
            stack.append((i, c))
        elif stack and c in "]})>":
            for k in range(len(stack) - 1, -1, -1):
                if _OPEN[stack[k][1]] == c:
                    if k == 0:
                        out.append((stack[0][0], i + 1, stack[0][1]))
                    del stack[k:]
                    break
    for mark in "*♪":
        at = [i for i, c in enumerate(text) if c == mark]
        out += [(a, b + 1, mark) for a, b in zip(at[::2], at[1::2], strict=False)]
    return sorted(out)


def label_number(label: str | None) -> int | None:
    """The number of a label written in any way, e.g. SPEAKER_01, spk 1, S1; None for names and unknown speakers."""
    m = _LABEL.fullmatch(label.strip().strip("[]():>").strip()) if label else None
    return int(m.group(1)) if m else None


def clean_segment(text: str | None) -> tuple[str, int | None, str | None, bool]:
    """(clean text, number of a label in the text, name before a colon, whether a word is spoken).

    The name is only a candidate: it is a label if the meeting's map has it; the clean text still holds it then.
    """
    if not text:
        return "", None, None, False
    low = text.lower()
    if len(low) != len(text):  # a few characters grow in lower case; positions must agree
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = [(end - n + 1, end + 1, kind) for end, (kind, n) in automaton().iter(low)]
    gone: list[tuple[int, int]] = []
    number = name = None
    sounds = [a for a, _, kind in hits if kind == "sound"]
    head = 0
    if m := _CUE.match(text):
        head = m.end()
        gone.append((0, head))
    for a, b, mark in _spans(text):
        if b <= head:
            continue
        inner = text[a + 1 : b - 1].strip(" ()[]")
        stamp = _STAMP.fullmatch(text[a:b])
        if stamp or mark in "[{<*♪" and label_number(inner) is None or any(a < s < b for s in sounds):
            gone.append((a, b))
            if not text[head:a].strip(" >"):
                head = b
        elif (n := label_number(inner)) is not None and not text[head:a].strip(" >"):
            number = n if number is None else number
            gone.append((a, b))
            head = b
    m = re.compile(r"[\s>]*").match(text, head)
    start = m.end()
    if m.group().strip():
        gone.append((head, start))
    if any(kind == "label" and a == start for a, _, kind in hits) and (m := _LABEL.match(text, start)):
        tail = re.compile(r"\s*(?::|-\s|–|—)\s*").match(text, m.end())
        if tail:
            number = int(m.group(1)) if number is None else number
            gone.append((start, tail.end()))
            start = tail.end()
    if number is None and (m := _NAME.match(text, start)):
        name = m.group(1)
    for a, b, kind in hits:
        if kind in ("label", "sound") or any(x <= a and b <= y for x, y in gone):
            continue
        edge = lambda c: not (c.isalnum() or c in "-'’")
        if (a and not edge(low[a - 1])) or (b < len(low) and not edge(low[b])):
            continue
        if kind == "phrase" and (_CLAUSE_BEFORE.search(low[max(0, a - 20) : a]) or _CLAUSE_AFTER.match(low, b)) and low[b : b + 1] not in (",", "."):
            continue
        tail = re.compile(r"\s*(?:\.{2,}|…|,)?").match(text, b)
        gone.append((a, tail.end()))
    keep, at = [], 0
    for a, b in sorted(gone):
        if a > at:
            keep.append(text[at:a])
        at = max(at, b)
    keep.append(text[at:])
    clean = re.sub(r"\s+([,.;:?!])", r"\1", re.sub(r"\s+", " ", " ".join(keep))).strip(" ,")
    spoken = bool(re.search(r"\w", clean))
    return (clean if spoken else ""), number, name, spoken


def clean_segments(df: DataFrame, text: str = "text", speaker: str = "speaker") -> DataFrame:
    """df without its text, with clean_text, label_no (column first, then text), label_name (candidate) and spoken.

    Null and empty texts are not spoken. A column named like a new one is refused; all others pass through.
    """
    new = [("clean_text", T.StringType()), ("label_no", T.IntegerType()), ("label_name", T.StringType()), ("text_name", T.StringType()), ("spoken", T.BooleanType())]
    keep = [c for c in df.columns if c != text]
    if clash := {n for n, _ in new} & set(keep):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in new])
    at = keep.index(speaker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        for b in batches:
            rows = []
            for t, s in zip(b.column(len(keep)).to_pylist(), b.column(at).to_pylist(), strict=True):
                clean, number, name, spoken = clean_segment(t)
                own = None if s is None or _UNKNOWN.fullmatch(s) else s
                n = label_number(own)
                rows.append((clean, n if n is not None else number, own if n is None else None, name, spoken))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(5))], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def _plain(c: object) -> object:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def speaker_names(meetings: DataFrame) -> DataFrame:
    """(meeting_id, name, number): over all versions of a meeting's speaker_map; labels of one name share its least number."""
    m = meetings.where("speaker_map is not null").select("meeting_id", F.explode("speaker_map").alias("label", "name"))
    m = m.select("meeting_id", _plain(F.col("name")).alias("name"), F.try_to_number(F.regexp_extract("label", r"(\d{1,4})\s*$", 1), F.lit("9999")).cast("int").alias("number"))
    return m.where("name <> '' and number is not null").groupBy("meeting_id", "name").agg(F.min("number").alias("number"), F.collect_set("number").alias("numbers"))


def turns(segments: DataFrame, meetings: DataFrame, max_gap: float = MAX_GAP_S, slice_s: float = SLICE_S, with_text: bool = True) -> DataFrame:
    """(meeting_id, first_segment_id, last_segment_id, speaker, start_s, end_s, n_segments[, text]), a row per turn.

    Rows repeated for a segment_id count once (the latest received). Segments without a spoken word, or with a null meeting
    or start, are left out first; a null end is taken as the start. Order is by start, end and id. The speaker is the
    column's name or label, else the text's; all segments of a meeting without either are one speaker, 'unknown'.
    Labels that the meeting's map gives one name are one speaker. Empty tables give an empty result.
    Speakers and turns are found on narrow rows; clean texts join them by segment at the end, if they are wanted.
    """
    cols = ["segment_id", "meeting_id", "start_s", "end_s", "text", "speaker", "received_at"]
    c = clean_segments(segments.where("meeting_id is not null and start_s is not null").select(cols))
    s = latest_rows(c.withColumn("end_s", F.coalesce("end_s", "start_s")), "segment_id", "received_at").where("spoken")
    if with_text:
        s = cut(s)
    names = speaker_names(meetings)
    by_name = names.select("meeting_id", F.col("name").alias("label_name"), F.col("number").alias("n1"))
    by_text = names.select("meeting_id", F.col("name").alias("text_name"), F.col("number").alias("n2"))
    by_no = names.where(F.size("numbers") > 1).select("meeting_id", F.explode("numbers").alias("no"), F.col("number").alias("n3"))
    n = s.select("segment_id", "meeting_id", "start_s", "end_s", "label_no", _plain(F.col("label_name")).alias("label_name"), _plain(F.col("text_name")).alias("text_name"))
    n = n.join(by_name, ["meeting_id", "label_name"], "left").join(by_text, ["meeting_id", "text_name"], "left")
    n = n.withColumn("no", F.coalesce("n1", "label_no", F.when(F.col("label_name").isNull(), F.col("n2")))).join(by_no, ["meeting_id", "no"], "left")
    number = F.coalesce("n3", "no")
    speaker = F.when(number.isNotNull(), F.concat(F.lit("speaker "), number.cast("string"))).otherwise(F.coalesce(F.concat(F.lit("name "), "label_name"), F.lit("unknown")))
    n = n.select("segment_id", "meeting_id", F.struct("start_s", "end_s", "segment_id").alias("at"), "start_s", "end_s", speaker.alias("speaker"), F.col("n2").isNotNull().alias("named"))

    p = with_previous(cut(n), "meeting_id", "at", F.col("start_s"), ["speaker", "end_s"], slice_s)
    opens = F.col("prev").isNull() | (F.col("prev.speaker") != F.col("speaker")) | (F.round(F.col("start_s") - F.col("prev.end_s"), 6) >= max_gap)
    t = with_island(cut(p), "meeting_id", "at", opens, "turn")
    out = [F.max("at").alias("last"), F.max("end_s").alias("end_s"), F.first("speaker").alias("speaker"), F.count("*").alias("n_segments")]
    if with_text:
        t = t.join(s.select("segment_id", "clean_text"), "segment_id")
        said = F.when(F.col("named"), F.ltrim(F.regexp_replace("clean_text", r"^(?:>>\s*)?[^:]{1,62}:\s*", ""))).otherwise(F.col("clean_text"))
        out.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("t")))), lambda x: x["t"]), " ").alias("text"))
    g = t.groupBy("meeting_id", "turn").agg(*out)
    keep = ["speaker", F.col("turn.start_s").alias("start_s"), "end_s", "n_segments"] + (["text"] if with_text else [])
    return g.select("meeting_id", F.col("turn.segment_id").alias("first_segment_id"), F.col("last.segment_id").alias("last_segment_id"), *keep)
