"""Lines repeated across the documents of one source: found by heavy-hitter summaries, confirmed by exact counts, removed.

First pass: each partition keeps, per source, a frequent-items summary of its documents' distinct lines (counters and
the total that pruning took away). Summaries merge by adding counters and losses, so that counter + loss bounds every
line's document count from above, whatever the partitioning. Second pass: only lines whose bound reaches
the threshold are counted exactly. A source with a third of all documents is summarised partition by
partition; its documents never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.session import cut

MIN_DOCS = 5
MIN_SHARE = 0.2
#: Candidate or confirmed lines up to which their set is broadcast (a line is two longs at most); larger sets are joined by shuffle.
BROADCAST_LINES = 1_000_000
#: Counters that a task holds over all its sources; beyond it their summaries are handed on and begun anew (they merge by addition).
TASK_COUNTERS = 2_000_000


def line_keys(text: Column) -> Column:
    """array<bigint>, one key per line: equal for lines that differ only in case, spacing and figures; null for blank lines."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^\S\n]+|[​﻿]", "")
    plain = F.regexp_replace(plain, r"\d(?:[\d.,:/-]*\d)?", "0")
    return F.transform(F.split(plain, "\n"), lambda x: F.when(x != "", F.xxhash64(x)))


def source_key(cols: list[str]) -> Column:
    """One bigint per source; nulls are a value of their own."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cols])


class Summary:
    """Frequent items of one source in one partition: at most 2 * capacity counters, and what every count may lack."""

    def __init__(self) -> None:
        self.counts: dict[int, int] = {}
        self.loss = self.docs = self.lines = 0

    def add(self, lines: list[int], share: float) -> None:
        self.docs += 1
        self.lines += len(lines)
        c = self.counts
        for x in lines:
            c[x] = c.get(x, 0) + 1
        capacity = int(4 / share * self.lines / self.docs) + 16
        if len(c) > 2 * capacity:
            cutoff = int(np.partition(np.fromiter(c.values(), np.int64, len(c)), -capacity)[-capacity])
            self.loss += cutoff
            self.counts = {k: v - cutoff for k, v in c.items() if v > cutoff}


def _candidates(keys: DataFrame, min_docs: int, min_share: float, most: int = TASK_COUNTERS) -> DataFrame:
    schema = pa.schema([(c, pa.int64()) for c in ("source", "line", "n", "loss", "docs")])

    def flat(held: dict[int, Summary]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for s, h in held.items():
            rows.append((s, None, 0, h.loss, h.docs))
            rows += [(s, k, n, 0, 0) for k, n in h.counts.items()]
            if len(rows) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}
        size = 0
        for b in batches:
            for s, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = held.setdefault(s, Summary())
                before = len(h.counts)
                h.add(lines, min_share)
                size += len(h.counts) - before + 1
                if size > most:
                    yield from flat(held)
                    held, size = {}, 0
        yield from flat(held)

    lines = keys.select("source", F.array_compact(F.array_distinct("keys")).alias("lines"))
    part = lines.mapInArrow(run, "source bigint, line bigint, n bigint, loss bigint, docs bigint")
    merged = cut(part.groupBy("source", "line").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("docs").alias("docs")))
    totals = merged.where("line is null").select("source", "loss", "docs")
    items = merged.where("line is not null").select("source", "line", "n")
    need = F.greatest(F.lit(min_docs), F.ceil(F.col("docs") * min_share - 1e-9))
    return items.join(totals, "source").where(F.col("n") + F.col("loss") >= need).select("source", "line", "docs")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few lines: rows, or elements where a row holds an array `cut` of them."""
    df = cut(df)
    size = F.sum(F.size("cut") + F.lit(1)) if "cut" in df.columns else F.count("*")
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= BROADCAST_LINES else df


def repeated_lines(docs: DataFrame, sources: list[str], doc_id: str = "id", text: str = "content_text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """(keys, confirmed): keys has id, source and the line keys of every document; confirmed the repeated lines of each source.

    Documents with a null or empty text are left out, rows repeated for a document id count once. Sources are told apart as
    spelled, nulls included. Documents of fewer than min_docs in a source cannot have a repeated line.
    """
    got = docs.where(F.length(text) > 0).select(F.col(doc_id).alias("id"), source_key(sources).alias("source"), line_keys(F.col(text)).alias("keys"))
    keys = cut(got.dropDuplicates(["id", "source", "keys"]))
    wanted = _candidates(keys, min_docs, min_share)
    each = keys.select("source", F.explode(F.array_distinct("keys")).alias("line"))
    exact = each.join(_small(wanted), ["source", "line"]).groupBy("source", "line").agg(F.count("*").alias("n"), F.max("docs").alias("docs"))
    confirmed = exact.where((F.col("n") >= min_docs) & (F.col("n") >= F.col("docs") * min_share - 1e-9))
    return keys, confirmed


def _sets(confirmed: DataFrame) -> DataFrame:
    """The confirmed lines of each source as one array: at most lines-per-document / min_share of them."""
    return _small(confirmed.groupBy("source").agg(F.collect_set("line").alias("cut")))


def found_lines(docs: DataFrame, sources: list[str], doc_id: str = "id", text: str = "content_text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(document_id, line_no) of the lines to take out; lines are numbered from 0, blank ones included."""
    keys, confirmed = repeated_lines(docs, sources, doc_id, text, min_docs, min_share)
    hit = keys.join(_sets(confirmed), "source").select("id", F.filter(F.transform("keys", lambda x, i: F.when(F.array_contains("cut", F.coalesce(x, F.lit(0))) & x.isNotNull(), i)), lambda x: x.isNotNull()).alias("at"))
    return hit.select(F.col("id").alias("document_id"), F.explode("at").alias("line_no")).distinct()


def without_repeated_lines(docs: DataFrame, sources: list[str], doc_id: str = "id", text: str = "content_text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, skip: Column | None = None) -> DataFrame:
    """docs with `clean_text` (the text without its repeated lines) and `lines_cut`.

    Rows for which `skip` is true (null is not true) neither count nor lose lines. Null texts stay null. All other columns
    pass through; a column named clean_text or lines_cut is refused. Every row stays, repeated ones too.
    """
    if clash := {"clean_text", "lines_cut"} & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    skip = F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))
    _, confirmed = repeated_lines(docs.where(~skip), sources, doc_id, text, min_docs, min_share)
    sets = _sets(confirmed).withColumnRenamed("source", "__source").withColumnRenamed("cut", "__cut")
    full = docs.withColumn("__source", F.when(~skip, source_key(sources))).join(sets, "__source", "left")
    full = full.withColumn("__keys", line_keys(F.col(text))).withColumn("__lines", F.split(text, "\n"))
    kept = F.filter("__lines", lambda x, i: ~F.coalesce(F.array_contains("__cut", F.coalesce(F.get("__keys", i), F.lit(0))) & F.get("__keys", i).isNotNull(), F.lit(False)))
    full = full.withColumn("__kept", kept)
    return full.select(*docs.columns, F.array_join("__kept", "\n").alias("clean_text"), (F.size("__lines") - F.size("__kept")).alias("lines_cut"))
