"""Transcripts of speech recognition and of two vendors' word tokens, on one segment schema; audio headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORDS = "array<struct<word:string,start:double,end:double,score:double,speaker:string>>"
ASR = f"version int, audio_key string, created_at string, model string, language string, duration_seconds double, segments array<struct<start:double,end:double,text:string,speaker:string,words:{_WORDS}>>"


def asr_segments(docs: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, start_s, end_s, text, speaker, words) with defaults 0, '' and null; documents without segments keep one empty row."""
    j = docs.select(key, F.from_json(payload, ASR).alias("j")).select(key, F.posexplode_outer("j.segments").alias("pos", "s"))
    return j.select(key, "pos", F.coalesce("s.start", F.lit(0.0)).alias("start_s"), F.coalesce("s.end", F.lit(0.0)).alias("end_s"), F.coalesce("s.text", F.lit("")).alias("text"), F.col("s.speaker").alias("speaker"), F.coalesce("s.words", F.array()).alias("words"))


_A_WORDS = "array<struct<text:string,start:double,end:double,speaker:string,confidence:double>>"
_A_UTT = "utterances array<struct<speaker:string,start:double,text:string>>"
_B = "results struct<channels:array<struct<alternatives:array<struct<words:array<struct<word:string,punctuated_word:string,start:double,end:double,speaker:int,confidence:double>>>>>>>"


def vendor_words(docs: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, word, start_s, end_s, speaker, confidence): times in seconds whichever vendor wrote them."""
    a = docs.where(F.trim(payload).startswith("[")).select(key, F.posexplode(F.from_json(payload, _A_WORDS)).alias("pos", "w"))
    a = a.select(key, "pos", F.col("w.text").alias("word"), (F.col("w.start") / 1000).alias("start_s"), (F.col("w.end") / 1000).alias("end_s"), F.col("w.speaker").alias("speaker"), F.col("w.confidence").alias("confidence"))
    b = docs.where(F.get_json_object(payload, "$.results").isNotNull()).select(key, F.posexplode(F.from_json(payload, _B)["results"]["channels"][0]["alternatives"][0]["words"]).alias("pos", "w"))
    b = b.select(key, "pos", F.coalesce("w.punctuated_word", "w.word").alias("word"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"), F.col("w.speaker").cast("string").alias("speaker"), F.col("w.confidence").alias("confidence"))
    return a.unionByName(b)


def vendor_utterances(docs: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, speaker, start_s, text) of documents that come as utterances."""
    u = docs.select(key, F.posexplode(F.from_json(payload, _A_UTT)["utterances"]).alias("pos", "u"))
    return u.select(key, "pos", F.col("u.speaker").alias("speaker"), (F.col("u.start") / 1000).alias("start_s"), F.col("u.text").alias("text"))


def wav_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, channels, rate, seconds, usable) of .wav files; usable is 16 kHz mono. Only the header's bytes are unpacked; damaged files have nulls."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
    return parse_wav(f.select("path", F.substring("content", 1, 4096).alias("head"), "length"))


def parse_wav(f: DataFrame) -> DataFrame:
    """The same of rows (path, head, length): the first bytes of a file and its whole size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, head, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = head.find(b"fmt ")
                data = head.find(b"data")
                if head[:4] != b"RIFF" or at < 0 or len(head) < at + 24:
                    rows.append((path, None, None, None))
                    continue
                _, channels, rate, per_second = struct.unpack_from("<HHII", head, at + 8)
                size = struct.unpack_from("<I", head, data + 4)[0] if 0 <= data <= len(head) - 8 else length
                rows.append((path, channels, rate, size / per_second if per_second else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["path", "channels", "rate", "seconds"])

    h = f.mapInArrow(run, "path string, channels int, rate int, seconds double")
    return h.withColumn("usable", F.coalesce((F.col("rate") == 16000) & (F.col("channels") == 1), F.lit(False)))


def with_sidecar(texts: DataFrame, meta: DataFrame, stem: str = "stem", most: int = 180_000) -> DataFrame:
    """Transcript texts with title and date of their `title|date` sidecar; `text` is cut to `most` characters, as the interface that takes it demands."""
    m = meta.select(stem, F.get(F.split("value", r"\|"), F.lit(0)).alias("title"), F.to_date(F.try_to_timestamp(F.get(F.split("value", r"\|"), F.lit(1)))).alias("day"))
    return texts.join(m, stem, "left").withColumn("text", F.left("text", F.lit(most)))
