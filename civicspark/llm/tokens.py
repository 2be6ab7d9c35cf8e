"""Encoding with a public byte-level BPE vocabulary, by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last one of its encoding. The table of these
last tokens is filled from left to right: a vocabulary entry that ends at the prefix is the last token when the
prefix before it is known to end in `prev` and the two tokens stay apart when their joined bytes are encoded.
The table makes appending exact without starting again, and an edit re-encodes only from the piece it touches.

Texts are cut into pieces by the vocabulary's pattern first; pieces repeat, so each worker fills the table once
for a distinct piece and keeps its ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Fixed value: the public pattern that cuts texts into pieces for the 50k byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Distinct pieces, and pairs of tokens, that a worker keeps; beyond it the memory starts anew (ids do not depend on it).
MEMORY = 400_000


class Encoder:
    """ranks: bytes of a token to its id, in the order of merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.bytes = ranks, {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self._apart: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Plain merging of a short byte string; the definition that the table must agree with."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: their joined bytes encode to just these two."""
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) >= MEMORY:
                self._apart.clear()
            known = self._apart[a, b] = self._merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill the table of last tokens for data, of which the first len(last) prefixes are known already."""
        ranks = self.ranks
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                t = ranks.get(data[start:end])
                if t is not None and (start == 0 and self._whole(t) or start and self.apart(last[start - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def _whole(self, t: int) -> bool:
        known = self._apart.get((-1, t))
        if known is None:
            known = self._apart[-1, t] = self._merge(self.bytes[t]) == [t]
        return known

    def ids(self, data: bytes, last: list[int]) -> list[int]:
        """Read the encoding back from the table."""
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes[last[end - 1]])
        return out[::-1]

    def piece(self, p: str) -> list[int]:
        known = self._pieces.get(p)
        if known is None:
            data = p.encode("utf-8", "surrogatepass")
            known = [self.ranks[data]] if data in self.ranks else self.ids(data, self.extend(data, []))
            if len(self._pieces) >= MEMORY:
                self._pieces.clear()
            self._pieces[p] = known
        return known

    def encode(self, text: str) -> list[int]:
        pieces, get = self.pattern.findall(text), self._pieces.get
        out: list[int] = []
        for p in pieces:
            out += get(p) or self.piece(p)
        return out

    def count(self, text: str) -> int:
        get = self._pieces.get
        return sum([len(get(p) or self.piece(p)) for p in self.pattern.findall(text)])


@dataclass
class PrefixState:
    """A text under edit: its pieces and, for each, the table of last tokens of its byte prefixes."""

    encoder: Encoder
    pieces: list[str] = field(default_factory=list)
    tables: list[list[int]] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        return [i for p, t in zip(self.pieces, self.tables, strict=True) for i in self.encoder.ids(p.encode("utf-8", "surrogatepass"), t)]

    def append(self, more: str) -> PrefixState:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> PrefixState:
        """Replace text[start:end]; tables of pieces before and after the touched stretch stay as they are.

        Cutting looks at most one character ahead, so pieces that end two before the edit keep their bounds; the
        tail is kept from the first old bound that the new cutting meets again.
        """
        text = self.text
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep]) < start:
            at += len(self.pieces[keep])
            keep += 1
        back = keep
        while back and (keep - back < 2 or self.pieces[back].isspace() or self.pieces[back - 1].isspace()):
            back -= 1
            at -= len(self.pieces[back])
        changed = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        bounds, pos = {}, 0
        for k, p in enumerate(self.pieces):
            if pos >= end:
                bounds[pos + shift] = k
            pos += len(p)
        pieces, tables = self.pieces[:back], self.tables[:back]
        old = {p: t for p, t in zip(self.pieces[back : keep + 2], self.tables[back : keep + 2], strict=True)}
        for m in self.encoder.pattern.finditer(changed, at):
            k = bounds.get(m.start())
            if k is not None and m.start() > start + len(new) and self.pieces[k] == m.group():
                pieces += self.pieces[k:]
                tables += self.tables[k:]
                break
            p = m.group()
            data = p.encode("utf-8", "surrogatepass")
            base = next((t for q, t in old.items() if p.startswith(q)), [])
            pieces.append(p)
            tables.append(self.encoder.extend(data, list(base)))
        self.pieces, self.tables = pieces, tables
        return self


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Broadcast:
    """The vocabulary file's bytes (under 1 MB) for all executors, so that only the driver needs the folder."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(raw: Broadcast) -> Encoder:
    """One encoder for a Python worker's life."""
    data = raw.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(data))
    return _ENCODERS[key]


def encode_table(df: DataFrame, text: str = "text", out: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """df with the text column replaced by its token ids (array<int>), without special tokens.

    Null and empty texts have the ids []. Strings of special tokens are ordinary text. Other columns pass through;
    a column named like `out` is refused. Rows keep their number, repeats included.
    """
    keep = [c for c in df.columns if c != text]
    if out in keep:
        raise ValueError(f"the table has a column {out} already")
    raw = vocabulary(df.sparkSession, name, folder)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(raw)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            all_ids: list[int] = []
            ends = [0]
            for t in texts:
                if t:
                    all_ids += enc.encode(t)
                ends.append(len(all_ids))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(all_ids, np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), ids], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def count_table(df: DataFrame, text: str = "text", out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """As encode_table, with the number of tokens only (0 for null and empty texts)."""
    keep = [c for c in df.columns if c != text]
    if out in keep:
        raise ValueError(f"the table has a column {out} already")
    raw = vocabulary(df.sparkSession, name, folder)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(raw)
        for b in batches:
            n = pa.array([enc.count(t) if t else 0 for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), n], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)
