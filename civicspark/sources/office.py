"""Text of office files with the standard library alone; extractors are plug-ins by extension."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_W, _A = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _number(name: str) -> int:
    return int(re.sub(r"\D", "", name.rsplit("/", 1)[-1]) or 0)


def docx_text(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paras = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n".join(p for p in paras if p.strip())


def xlsx_text(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        lines = []
        for sheet in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number):
            for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                if any(cells):
                    lines.append("\t".join(cells))
    return "\n".join(lines)


def pptx_text(raw: bytes) -> str:
    """Slides under numbered headers: frames line by line, tables with bars, notes under their own prefix."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        out = []
        for slide in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number):
            root = ElementTree.fromstring(z.read(slide))
            in_table = {id(p) for t in root.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}
            lines = [x for p in root.iter(f"{_A}p") if id(p) not in in_table and (x := "".join(t.text or "" for t in p.iter(f"{_A}t"))).strip()]
            lines += [" | ".join("".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.iter(f"{_A}tc")) for r in root.iter(f"{_A}tr")]
            notes = f"ppt/notesSlides/notesSlide{_number(slide)}.xml"
            if notes in names:
                said = " ".join(x for p in ElementTree.fromstring(z.read(notes)).iter(f"{_A}p") if (x := "".join(t.text or "" for t in p.iter(f"{_A}t"))).strip())
                lines += [f"Notes: {said}"] if said else []
            out.append("\n".join([f"--- Slide {_number(slide)} ---", *lines]))
    return "\n\n".join(out)


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text, "ppsx": pptx_text, "txt": lambda b: b.decode("utf-8", "replace")}


def extract(files: DataFrame, more: dict[str, Callable[[bytes], str]] | None = None, least_chars: int = 1) -> DataFrame:
    """(path, status, text, char_count, warning, error) of binaryFile rows: complete, pending (no extractor for the type) or failed.

    A text of fewer than least_chars characters gets a warning; an extractor's exception fails its file, never the task.
    """
    table = EXTRACTORS | (more or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = table.get(path.rsplit(".", 1)[-1].lower())
                if f is None:
                    rows.append((path, "pending", None, None, None, "no extractor for this type"))
                    continue
                try:
                    t = f(raw)
                    rows.append((path, "complete", t, len(t), "little text" if len(t.strip()) < least_chars else None, None))
                except Exception as e:
                    rows.append((path, "failed", None, None, None, f"{type(e).__name__}: {e}"[:500]))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "status", "text", "char_count", "warning", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, status string, text string, char_count int, warning string, error string")


#: Fixed value: characters below which a page's own text layer counts as missing.
TIER_CHARS = 100


def tiered(first: Callable[[bytes], str], second: Callable[[bytes], str], least: int = TIER_CHARS) -> Callable[[bytes], str]:
    """An extractor that asks `second` where `first` fails or gives fewer than `least` characters, and keeps the longer text."""

    def run(raw: bytes) -> str:
        try:
            a = first(raw) or ""
        except Exception:
            a = ""
        if len(a.strip()) >= least:
            return a
        b = second(raw) or ""
        return b if len(b.strip()) > len(a.strip()) else a

    return run
