"""Scalar functions on text, dates and numbers as Column expressions; all of them stay inside code generation.

Nulls give null unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a meeting's name and the type they stand for, in order of precedence.
MEETING_TYPES = [
    ("regular meeting", "Regular Meeting"), ("special meeting", "Special Meeting"), ("executive session", "Executive Session"), ("work session", "Work Session"),
    ("workshop", "Work Session"), ("study session", "Study Session"), ("retreat", "Retreat"),
]
#: The same for the names of audio files.
FILE_TYPES = [
    ("regular_board_meeting", "Regular Board Meeting"), ("special_board_meeting", "Special Board Meeting"), ("executive_session", "Executive Session"),
    ("work_session", "Work Session"), ("board_retreat", "Board Retreat"),
]
#: Words that ask for a personnel action.
ACTION_VERBS = ["hired", "retired", "resigned", "terminated", "appointed", "promoted", "transferred", "contract", "retirement", "resignation", "hiring", "appointment"]
#: Words of a PDF's creator that mean a scanner.
SCANNER_WORDS = ["scan", "canon", "xerox", "ricoh", "kyocera", "konica", "epson"]
ATTACHMENT_TYPES = [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".txt", ".html"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def html_text(html: Column, separator: str = " ") -> Column:
    """Text of an HTML fragment: comments, scripts and styles dropped, tags replaced, the common entities decoded, white space collapsed.

    With a newline as separator the pieces are trimmed and empty ones dropped.
    """
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\u0001")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    if separator == "\n":
        pieces = F.filter(F.transform(F.split(t, "\u0001"), strip), lambda x: x != "")
        return F.array_join(pieces, "\n")
    return strip(F.regexp_replace(F.regexp_replace(t, "\u0001", separator), r"\s+", " "))


def definition(html: Column, term: str, default: str) -> Column:
    """The dd after the dt `term`; default if absent or empty."""
    got = html_text(F.regexp_extract(html, rf"(?is)<dt[^>]*>\s*{term}\s*:?\s*</dt>\s*<dd[^>]*>(.*?)</dd>", 1))
    return F.coalesce(nonempty(got), F.lit(default))


def goal_names(html: Column) -> Column:
    """Texts of the name divs inside goal divs, in order, of well-formed fragments."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<div class="goal">.*?<div class="name">(.*?)</div>'), 1)
    return F.filter(F.transform(found, lambda x: html_text(x)), lambda x: x != "")


def loose_date(c: Column) -> Column:
    """yyyyMMdd or ISO dates; null for anything else."""
    s = strip(c)
    return F.coalesce(F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd")), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd")))


def iso_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def file_date(name: Column) -> Column:
    """A date M_D_YY or M_D_YYYY at the end of a file's stem; two-digit years are of this century."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    pattern = r"(\d{1,2})_(\d{1,2})_(\d{2,4})\s*$"
    year = F.regexp_extract(stem, pattern, 3)
    year = F.when(F.try_add(year.try_cast("int"), F.lit(0)) < 100, (year.try_cast("int") + 2000).cast("string")).otherwise(year)
    return F.when(stem.rlike(pattern), _ymd(year, F.regexp_extract(stem, pattern, 1), F.regexp_extract(stem, pattern, 2)))


def month_name_date(name: Column) -> Column:
    """A date ddMONyyyy anywhere in a name."""
    pattern = r"(?i)(\d{1,2})(" + "|".join(MONTHS) + r")(\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(name, pattern, 2)))
    return F.when(name.rlike(pattern), _ymd(F.regexp_extract(name, pattern, 3), month.cast("string"), F.regexp_extract(name, pattern, 1)))


def first_match(c: Column, pairs: list[tuple[str, str]], otherwise: Column) -> Column:
    low = F.lower(c)
    out = None
    for part, value in pairs:
        hit = low.contains(part)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def meeting_type(name: Column) -> Column:
    return first_match(name, MEETING_TYPES, F.left(name, F.lit(255)))


def file_meeting_type(name: Column) -> Column:
    return first_match(name, FILE_TYPES, F.lit("Board Meeting"))


def clean_dashes(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit("\\---"), F.lit("")), F.lit("---"), F.lit("")))


def permalink(base: Column, meeting: Column, item: Column) -> Column:
    """The item's link, else the meeting's; null if neither has an id (empty ids count as none)."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/goto?open&id="), F.coalesce(nonempty(item), nonempty(meeting)))


def safe_url(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?://"), url)


def query_parameter(url: Column, key: str) -> Column:
    return nonempty(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1))


def suppressed_number(c: Column, default: float = 0.0) -> Column:
    """Numbers as published: percent signs and commas dropped, a leading < or > ignored; markers of suppression give default."""
    s = F.regexp_replace(strip(F.regexp_replace(c, "[%,]", "")), "^[<>]", "")
    return F.coalesce(F.when(~F.lower(s).contains("suppress"), s.try_cast("double")), F.lit(default))


#: Words that are no person's name though they are written like one.
STOP_NAMES = ["board", "director", "superintendent", "president", "council", "committee", "state", "washington", "kent", "district", "school", "staff", "public", "speaker", "member"]


def title_name(c: Column) -> Column:
    """Every run of letters capitalised, the rest in lower case; null outside 4 to 40 characters and for STOP_NAMES."""
    s = strip(F.regexp_replace(c, r"\s+", " "))
    pieces = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}]+|[^\p{L}]+"), 0)
    t = F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 10_000))), "")
    return F.when(F.length(s).between(4, 40) & ~F.lower(s).isin(STOP_NAMES), t)


def slug(c: Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.left(s, F.lit(most)), "-+$", "")


def without_header(c: Column) -> Column:
    """Trimmed text without a markdown header in its first line."""
    return strip(F.regexp_replace(strip(c), r"^#{1,6}[ \t][^\n]*\n?", ""))


def dense_length(c: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(c, r"\s", ""))


#: What stands on a page without content.
BLANK_NOTES = ["intentionally blank", "this page intentionally blank", "this page is intentionally blank", "this page intentionally left blank", "this page is intentionally left blank"]


def blank_page(c: Column) -> Column:
    """Whether the text is one of BLANK_NOTES, regardless of case and spacing."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " "))).isin(BLANK_NOTES)


def header_only(c: Column, title: Column) -> Column:
    body = without_header(c)
    return (body == "") | (F.lower(body) == F.lower(strip(F.coalesce(title, F.lit("")))))


def low_value(c: Column, title: Column, least: int = 50) -> Column:
    """'short', 'blank', 'header' or null, in this order of precedence."""
    short = (dense_length(c) < least) & (dense_length(without_header(c)) < least)
    return F.when(short, "short").when(blank_page(c), "blank").when(header_only(c, title), "header")


def page_class(text: Column, area: Column, error: Column | None = None) -> Column:
    """TEXT_RICH, TEXT_SPARSE, IMAGE_ONLY, or UNREADABLE where `error` is given."""
    n = F.length(strip(F.coalesce(text, F.lit(""))))
    density = F.when(area > 0, n / area).otherwise(0.0)
    tokens = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: F.length(x) >= 3))
    c = F.when((n > 100) & (density > 0.001) & (tokens >= 3), "TEXT_RICH").when(n >= 10, "TEXT_SPARSE").otherwise("IMAGE_ONLY")
    return c if error is None else F.when(error.isNotNull(), "UNREADABLE").otherwise(c)


def word_ratio(text: Column, dictionary: list[str]) -> Column:
    """Share of tokens that the dictionary has, punctuation at their edges dropped."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    plain = F.transform(tokens, lambda x: F.regexp_replace(x, r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", ""))
    known = F.array(*map(F.lit, dictionary))
    return F.try_divide(F.size(F.filter(plain, lambda x: F.array_contains(known, x))), F.size(tokens))


def ocr_overlay(text: Column, kind: Column, dictionary: list[str], least_tokens: int = 5, ratio: float = 0.4) -> Column:
    tokens = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))
    return F.coalesce((kind == "TEXT_SPARSE") & (tokens >= least_tokens) & (word_ratio(text, dictionary) < ratio), F.lit(False))


def scanner_origin(creator: Column, producer: Column) -> Column:
    return F.lower(F.concat(F.coalesce(creator, F.lit("")), F.lit(" "), F.coalesce(producer, F.lit("")))).rlike("|".join(SCANNER_WORDS))


def clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("string"), F.floor((s % 3600) / 60).cast("string"), (s % 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit(":"), F.lpad(m, 2, "0"), F.lit(":"), F.lpad(r, 2, "0"))).otherwise(F.concat(m, F.lit(":"), F.lpad(r, 2, "0")))


def turn_line(speaker: Column, start: Column, end: Column, wpm: Column, confidence: Column, overlap: Column, pause: Column, text: Column) -> Column:
    """A turn as a line with its times and, where they say something, pace, confidence, overlap and a long pause."""
    notes = F.concat_ws(
        ", ", F.when(wpm > 0, F.format_string("%.0f wpm", F.rint(wpm))), F.when(confidence > 0, F.format_string("conf:%.2f", confidence)), F.when(overlap, F.lit("overlapping")), F.when(pause > 3, F.format_string("pause:%.1fs", pause))
    )
    return F.concat(F.lit("["), speaker, F.lit("] ("), clock(start), F.lit("-"), clock(end), F.lit(")"), F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""), F.lit(": "), text)


def comparison_text(c: Column) -> Column:
    """For comparing transcripts: lower case, words of any script and apostrophes only, single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s']", ""), r"\s+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def tokens_by_words(c: Column) -> Column:
    return F.floor(word_count(c) * 1.3).cast("int")


def tokens_by_chars(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def fenced_json(c: Column) -> Column:
    """The JSON text inside a fenced block, else the trimmed text."""
    return F.coalesce(nonempty(strip(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1))), strip(c))


def last_json_block(c: Column) -> Column:
    """The last innermost {...} block."""
    return F.get(F.reverse(F.regexp_extract_all(c, F.lit(r"\{[^{}]*\}"), 0)), F.lit(0))


def dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c)


def sigmoid(c: Column) -> Column:
    return F.when(c >= 0, 1 / (1 + F.exp(-c))).otherwise(F.exp(c) / (1 + F.exp(c)))


def keyword_query(query: Column, names: Column) -> Column:
    """The words of a query that belong to a person's name, if there is a name and a personnel verb; else the query."""
    words = F.filter(F.split(query, r"\s+"), lambda x: x != "")
    in_names = F.flatten(F.transform(names, lambda n: F.split(F.lower(n), r"\s+")))
    verbs = F.array(*map(F.lit, ACTION_VERBS))
    kept = F.filter(words, lambda w: F.array_contains(in_names, F.lower(w)))
    asks = F.exists(words, lambda w: F.array_contains(verbs, F.lower(w)))
    return F.when((F.size(names) > 0) & asks & (F.size(kept) > 0), F.array_join(kept, " ")).otherwise(query)


def clamp(c: Column, low: int, high: int | None = None, default: int = 0) -> Column:
    v = F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low))
    return v if high is None else F.least(v, F.lit(high))


def redact_dsn(c: Column) -> Column:
    return F.regexp_replace(c, r"(://[^:/@\s]+):[^@\s]+@", "$1:***@")


def attachment_extension(name: Column) -> Column:
    """The lower-case extension if it is one of an attachment and the file is not hidden."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return F.when(~name.startswith(".") & ext.isin(ATTACHMENT_TYPES), ext)


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\u001b\\[[0-9;?]*[A-Za-z]", "")
