"""Texts and transcripts cut into chunks.

Packing is sequential within one document or meeting and independent between them. Each packer works on arrays of
unit sizes (sentences, lines, words, paragraphs) and finds chunk bounds on their running sums, one Arrow batch at a time; a
document never leaves its row, so packing texts needs no shuffle. Sizes are counted by an injectable counter; the
default counts words between white space.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Counter = Callable[[str], int]


def by_words(text: str) -> int:
    return len(text.split())


def sentences(text: Column) -> Column:
    """Non-empty trimmed sentences: cut at white space after . ! or ?"""
    parts = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def cut_sentences(text: str) -> list[str]:
    return [p for p in map(str.strip, _SENTENCE.split(text.strip())) if p]


def pack_sentences(text: str | None, target: int = 384, overlap: int = 38, least: int = 100, count: Counter = by_words) -> list[tuple[str, int]]:
    """(chunk, size) with whole sentences of up to `target` units.

    A sentence above the target that meets no open chunk is one of its own, and nothing is repeated after it. A chunk starts with
    the last sentences of the one before: as many as fit in `overlap`, at least one; this overlap is not checked against the
    target again. Chunks below `least` are dropped if there are others; if none is left, the whole text is one.
    """
    if not text or not text.strip():
        return []
    parts = cut_sentences(text)
    size = [count(p) for p in parts]
    total = [0, *accumulate(size)]
    spans: list[tuple[int, int]] = []
    start = end = 0  # the open chunk is parts[start:end]
    for i, n in enumerate(size):
        if start == end and n > target:
            spans.append((i, i + 1))
            start = end = i + 1
            continue
        if start < end and total[end] - total[start] + n > target:
            spans.append((start, end))
            start = min(end - 1, max(start, _fits_before(total, end, overlap)))
        end = i + 1
    if start < end:
        spans.append((start, end))
    chunks = [(c, count(c)) for c in (" ".join(parts[a:b]) for a, b in spans)]
    if len(chunks) > 1:
        chunks = [c for c in chunks if c[1] >= least]
    return chunks or [(text.strip(), count(text.strip()))]


def _fits_before(total: list[int], end: int, room: int) -> int:
    """The least start from which total[end] - total[start] <= room."""
    start = end
    while start and total[end] - total[start - 1] <= room:
        start -= 1
    return start


def pack_paragraphs(text: str | None, most: int = 1500, overlap: int = 200) -> list[str]:
    """Paragraphs (cut at blank lines) of up to `most` characters in all; a longer chunk hands its last `overlap` characters on."""
    out: list[str] = []
    open_text = ""
    for p in re.split(r"\n{2,}", text or ""):
        if open_text and len(open_text) + len(p) + 2 > most:
            out.append(open_text.strip())
            open_text = open_text[-overlap:] + "\n\n" + p if len(open_text) > overlap else p
        else:
            open_text = f"{open_text}\n\n{p}" if open_text else p
    return out + [open_text.strip()] if open_text.strip() else out


def pack_lines(rows: Iterable[tuple], target: int = 384, least: int = 100, count: Counter = by_words) -> Iterator[tuple]:
    """(content, size, speakers, time_start, time_end) of (line, speaker, start, end) rows packed up to `target`.

    A chunk repeats the last line of the one before; speakers and time_start tell of its own lines only. Chunks below `least`
    are dropped, but for the first.
    """
    own: list[tuple] = []
    repeated: tuple | None = None
    used, kept = 0, False

    def chunk() -> tuple:
        content = "\n".join(r[0] for r in ([repeated] if repeated else []) + own)
        return content, count(content), sorted({r[1] for r in own}), float(own[0][2] or 0.0), own[-1][3]

    for r in rows:
        n = count(r[0])
        if own and used + n > target:
            c = chunk()
            if c[1] >= least or not kept:
                kept = True
                yield c
            repeated, own, used = own[-1], [], count(own[-1][0])
        own.append(r)
        used += n
    if own:
        c = chunk()
        if c[1] >= least or not kept:
            yield c


def pack_words(rows: Iterable[tuple], most: int = 150) -> Iterator[tuple]:
    """(content,) of (speaker, start, text) rows of up to `most` words in all, without overlap; longer utterances are cut every `most` words."""
    held: list[str] = []
    used = 0
    for speaker, _, text in rows:
        ws = text.split()
        if held and used + len(ws) > most:
            yield ("\n".join(held),)
            held, used = [], 0
        if len(ws) > most:
            for k in range(0, len(ws), most):
                yield (f"[{speaker}]: {' '.join(ws[k : k + most])}",)
        else:
            held.append(f"[{speaker}]: {text}")
            used += len(ws)
    if held:
        yield ("\n".join(held),)


def pack_speaker(rows: Iterable[tuple], target: int = 150, stretch: float = 1.5) -> Iterator[tuple]:
    """(content, speaker, start): neighbouring utterances of one speaker up to `target` words; longer ones than stretch * target are cut at sentences."""
    texts: list[str] = []
    who: tuple = ()
    used = 0

    def flush() -> Iterator[tuple]:
        text = " ".join(texts).strip()
        if text:
            for p in _by_sentence(text, target) if used > int(target * stretch) else [text]:
                yield (p, *who)

    for speaker, start, text in rows:
        n = by_words(text)
        if texts and (speaker != who[0] or used + n > target):
            yield from flush()
            texts, used = [], 0
        if not texts:
            who = (speaker, start)
        if text:
            texts.append(text)
            used += n
    yield from flush()


def _by_sentence(text: str, target: int) -> list[str]:
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    total = [0, *accumulate(map(by_words, parts))]
    out, a = [], 0
    while a < len(parts):
        b = max(a + 1, bisect_right(total, total[a] + target) - 1)
        out.append(" ".join(parts[a:b]).strip())
        a = b
    return out


CHUNK = [T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("token_count", T.IntegerType())]


def chunk_texts(df: DataFrame, key: str, text: str, packer: Callable[[str | None], list], count: Counter = by_words) -> DataFrame:
    """(key, chunk_index, content, token_count) of every text, without a shuffle. packer gives chunks or (chunk, size)."""
    schema = T.StructType([df.schema[key], *CHUNK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, index, content, size = [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                for k, c in enumerate(packer(t)):
                    c = c if isinstance(c, tuple) else (c, count(c))
                    at.append(row)
                    index.append(k)
                    content.append(c[0])
                    size.append(c[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(content, pa.string()), pa.array(size, pa.int32())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def _packed(df: DataFrame, group: str, order: list[str], fields: list[str], packer: Callable[[Iterable[tuple]], Iterator[tuple]], columns: str) -> DataFrame:
    """packer over each group's rows in order, as a stream: a group is never held, only its open chunk."""
    kind = dict(df.dtypes)[group]
    k = len(fields)
    schema = T.StructType.fromDDL(f"`{group}` {kind}, chunk_index int, {columns}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(k + 1)), strict=True))
        out: list[tuple] = []
        for key, g in groupby(rows, key=lambda r: r[0]):
            for index, c in enumerate(packer(r[1:] for r in g)):
                out.append((key, index, *c))
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.repartition(group).sortWithinPartitions(group, *order).select(group, *fields).mapInArrow(run, schema)


def chunk_turns(lines: DataFrame, group: str, order: list[str], target: int = 384, least: int = 100, count: Counter = by_words) -> DataFrame:
    """Turn lines (line, speaker, start_s, end_s) of each group, packed in order."""
    return _packed(lines, group, order, ["line", "speaker", "start_s", "end_s"], lambda g: pack_lines(g, target, least, count), "content string, token_count int, speakers array<string>, time_start double, time_end double")


def chunk_turn_rows(rows: DataFrame, group: str, target: int = 384, least: int = 100, count: Counter = by_words) -> DataFrame:
    """The same from the segments of turns (dialogue.turn_rows): a turn's line is put together while its group is packed."""

    def lines(g: Iterable[tuple]) -> Iterator[tuple]:
        for (_, head, speaker, start, end), parts in groupby(g, key=lambda r: ((r[0]["start_s"], r[0]["segment_id"]), *r[1:5])):
            yield head + " ".join(r[5] for r in parts if r[5] is not None), speaker, start, end

    return _packed(rows, group, ["at"], ["turn", "head", "speaker", "time_start", "time_end", "text"], lambda g: pack_lines(lines(g), target, least, count), "content string, token_count int, speakers array<string>, time_start double, time_end double")


def chunk_utterances(df: DataFrame, group: str, order: list[str], how: str = "words", target: int = 150) -> DataFrame:
    """Utterances (speaker, start_s, text) of each group, packed in order by 'words' or by 'speaker'; null texts are empty."""
    rows = df.withColumn("text", F.coalesce("text", F.lit("")))
    if how == "words":
        return _packed(rows, group, order, ["speaker", "start_s", "text"], lambda g: pack_words(g, target), "content string")
    return _packed(rows, group, order, ["speaker", "start_s", "text"], lambda g: pack_speaker(g, target), "content string, speaker string, start_s double")


def render_rows(df: DataFrame, group: list[str], order: list[Column], title: Column, line: Column) -> DataFrame:
    """Records as text: a title and one line per row in order."""
    g = df.groupBy(*group).agg(F.first(title).alias("t"), F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], line.alias("line")))).alias("ls"))
    return g.select(*group, F.concat(F.col("t"), F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("content"))
