"""Models as plug-ins, with deterministic defaults that need none: embedder, name extractor, text model, word error rate."""

from __future__ import annotations

import difflib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from civicspark.functions.text import comparison_text, title_name


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words, normalised; empty texts are the zero vector."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[k, h % self.dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def embed(df: DataFrame, key: str, text: str, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """(key, embedding): the model is made once per worker task; an Arrow batch is one call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            v = model.encode(b.column(1).to_pylist())
            flat = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel().astype(np.float32)), model.dim).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def person_names(text: Column) -> Column:
    """Default name extractor: distinct runs of two or three capitalised words, as names are normalised."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\p{Lu}[\p{L}'’\-]+(?: \p{Lu}[\p{L}'’\-]*\.?){1,2})"), 1)
    return F.array_compact(F.array_distinct(F.transform(found, lambda x: title_name(x))))


def with_fallback(call: Callable[[str], str | None], fallback: Callable[[str], str]) -> Callable[[str], str]:
    """A text model's call that never fails: any exception or empty answer gives the fallback."""

    def safe(prompt: str) -> str:
        try:
            return call(prompt) or fallback(prompt)
        except Exception:
            return fallback(prompt)

    return safe


def word_error_rate(reference: str, heard: str) -> float:
    """By the alignment of longest matching blocks: the longer side of each differing stretch over the reference's words.

    An empty reference gives 0 for an empty text, else 1.
    """
    a, b = reference.split(), heard.split()
    if not a:
        return float(bool(b))
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    i = j = wrong = 0
    for m in blocks:
        wrong += max(m.a - i, m.b - j)
        i, j = m.a + m.size, m.b + m.size
    return wrong / len(a)


def word_edit_rate(reference: str, heard: str) -> float:
    """The true edit distance of the words over the reference's words."""
    a, b = reference.split(), heard.split()
    if not a:
        return float(bool(b))
    row = np.arange(len(b) + 1)
    ids = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    y = np.array([ids[w] for w in b], np.int64)
    for i, w in enumerate(a, 1):
        best = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (y != ids[w]))))
        row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
    return float(row[-1]) / len(a)


@pandas_udf(DoubleType())
def _wer(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else word_error_rate(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def wer(reference: Column, heard: Column) -> Column:
    """Word error rate of two texts after normalisation; null if either is null."""
    return _wer(comparison_text(reference), comparison_text(heard))


class Breaker:
    """Guards a service: after `most` failures in a row its calls are refused for `rest_s` seconds; then one call is let through to try it."""

    def __init__(self, call: Callable, most: int = 5, rest_s: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.call, self.most, self.rest_s, self.clock = call, most, rest_s, clock
        self.failures, self.since = 0, 0.0

    def __call__(self, *args: object) -> object:
        if self.failures >= self.most and self.clock() - self.since < self.rest_s:
            raise ConnectionError("the service is resting after failures")
        try:
            got = self.call(*args)
        except Exception:
            self.failures, self.since = self.failures + 1, self.clock()
            raise
        self.failures = 0
        return got
