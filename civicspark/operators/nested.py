"""Nested records to flat tables, by columnar shredding with repetition and definition levels.

Every leaf path of a nested Arrow column becomes three sequences: its values, a repetition level
(the deepest list that was continued; 0 starts a record) and a definition level (how many optional
or repeated steps of the path are present). The table of a repeated ancestor is read back from the
level sequences alone: an entry is a row when its definition level reaches the ancestor's element,
and the ordinals that link it to its parents are running counts of repetition levels. All of it is
array arithmetic on one Arrow batch, so no shuffle is needed and no record is walked in Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Path = tuple[str, ...]


@dataclass
class Leaf:
    """One leaf path: levels for every entry, values for the entries with defs == max_def."""

    values: pa.Array
    reps: np.ndarray
    defs: np.ndarray
    lists: tuple[tuple[Path, int, int], ...]  # (path, repetition level, definition level of an element)
    max_def: int


def _valid(arr: pa.Array, idx: np.ndarray) -> np.ndarray:
    ok = idx >= 0
    if arr.null_count and len(arr):
        valid = arr.is_valid().to_numpy(zero_copy_only=False)
        ok = ok & valid[np.where(idx >= 0, idx, 0)]
    return ok


def shred(arr: pa.Array, root: Path = ()) -> dict[Path, Leaf]:
    """The leaves of a nested array. A null or absent step ends an entry early; an empty list keeps one entry."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    out: dict[Path, Leaf] = {}

    def walk(a: pa.Array, path: Path, idx: np.ndarray, reps: np.ndarray, defs: np.ndarray, lists: tuple, level: int) -> None:
        ok = _valid(a, idx)
        level += 1
        defs = defs + ok
        idx = np.where(ok, idx, -1)
        if pa.types.is_struct(a.type):
            for k in range(a.type.num_fields):
                walk(a.field(k) if a.offset == 0 else a.flatten()[k], (*path, a.type.field(k).name), idx, reps, defs, lists, level)
        elif pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
            offs = a.offsets.to_numpy().astype(np.int64)
            safe = np.where(idx >= 0, idx, 0)
            start = offs[safe] if len(a) else np.zeros(len(idx), np.int64)
            n = np.where(idx >= 0, (offs[safe + 1] if len(a) else start) - start, 0)
            count = np.maximum(n, 1)
            first = np.repeat(np.cumsum(count) - count, count)
            pos = np.arange(count.sum()) - first
            has = np.repeat(n > 0, count)
            child = np.where(has, np.repeat(start, count) + pos, -1)
            depth = len(lists) + 1
            level += 1
            walk(a.values, path, child, np.where(pos == 0, np.repeat(reps, count), depth), np.repeat(defs, count) + has, (*lists, (path, depth, level)), level)
        else:
            out[path] = Leaf(a.take(pa.array(idx[idx >= 0])), reps, defs, lists, level)

    n = len(arr)
    walk(arr, root, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), (), 0)
    return out


def _ordinals(leaf: Leaf, depth: int) -> list[np.ndarray]:
    """Per entry: the record's number and, for each list down to depth, the position in its parent's list."""
    reps = leaf.reps
    out = [np.cumsum(reps == 0) - 1]
    for k in range(1, depth + 1):
        tick = np.cumsum(reps <= k)
        opens = np.flatnonzero(reps < k)
        base = np.zeros(len(reps), np.int64)
        if len(opens):
            base[opens] = np.diff(np.concatenate(([0], tick[opens])))
        out.append(tick - np.cumsum(base))
    return out


def _column(leaf: Leaf) -> pa.Array:
    """The leaf's values with a null for each entry that lacks one."""
    at = np.cumsum(leaf.defs == leaf.max_def) - 1
    return leaf.values.take(pa.array(at, mask=leaf.defs != leaf.max_def))


def assemble(leaves: dict[Path, Leaf], ancestor: Path) -> dict[str, pa.Array | np.ndarray]:
    """The table of the repeated path `ancestor`: record, ordinals of each list, its own leaves and its ancestors' leaves.

    Rows exist for the elements that are there, null elements included (their leaves are null).
    """
    under = [x for x in leaves.values() if any(p == ancestor for p, _, _ in x.lists)]
    lead = min(under, key=lambda x: len(x.lists))
    depth, need = next((d, e) for p, d, e in lead.lists if p == ancestor)
    rows = np.flatnonzero((lead.reps <= depth) & (lead.defs >= need))
    ords = _ordinals(lead, depth)
    out: dict = {"record": ords[0][rows]} | {f"ord_{k}": ords[k][rows] for k in range(1, depth + 1)}
    chain = [p for p, _, _ in lead.lists[:depth]]
    for path, leaf in leaves.items():
        mine = [p for p, _, _ in leaf.lists]
        if mine != chain[: len(mine)]:
            continue
        k = len(mine)
        if k == depth:
            keep = np.flatnonzero(leaf.defs >= need)
            out["/".join(path)] = _column(leaf).take(pa.array(keep))
            continue
        own = _ordinals(leaf, k)
        width = [int(max([0, *a, *b])) + 1 for a, b in zip(own, ords[: k + 1], strict=True)]
        code = lambda cols, sel: np.ravel_multi_index([c[sel] for c in cols], width) if len(sel) else np.zeros(0, np.int64)
        order = np.arange(len(leaf.reps))
        keys = code(own, order)
        by = np.argsort(keys, kind="stable")
        hit = by[np.searchsorted(keys[by], code(ords[: k + 1], rows))] if len(rows) else np.zeros(0, np.int64)
        out["/".join(path)] = _column(leaf).take(pa.array(hit))
    return out


def flat_table(df: DataFrame, column: str, ancestor: Path, keep: list[str], names: dict[str, str]) -> DataFrame:
    """One row per element of the list at `ancestor` inside `column`, with `keep` of its row and `names` (leaf path: new name).

    The lists above it give ``ord_1``, ``ord_2`` ... (from 0), which identify the parent rows even where ids are
    null or repeated. Null or empty lists give no row; null elements a row of nulls. Repeated input rows stay repeated.
    """
    src = df.select(*keep, F.col(column).alias("__nested"))
    leaf_types = _leaf_types(src.schema["__nested"].dataType)
    depth = sum(1 for p in _list_paths(src.schema["__nested"].dataType) if ancestor[: len(p)] == p)
    schema = T.StructType(
        [src.schema[k] for k in keep]
        + [T.StructField(f"ord_{k}", T.LongType()) for k in range(1, depth + 1)]
        + [T.StructField(new, leaf_types[tuple(p.split("/"))]) for p, new in names.items()]
    )
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = assemble(shred(b.column(b.schema.get_field_index("__nested"))), ancestor)
            rec = pa.array(t["record"])
            cols = [b.column(k).take(rec) for k in range(len(keep))]
            cols += [pa.array(t[f"ord_{k}"]) for k in range(1, depth + 1)]
            cols += [t[p] for p in names]
            yield pa.RecordBatch.from_arrays([c.cast(x) if c.type != x else c for c, x in zip(cols, arrow, strict=True)], names=schema.names)

    return src.mapInArrow(run, schema)


def _leaf_types(t: T.DataType, path: Path = ()) -> dict[Path, T.DataType]:
    if isinstance(t, T.ArrayType):
        return _leaf_types(t.elementType, path)
    if isinstance(t, T.StructType):
        return {k: v for f in t.fields for k, v in _leaf_types(f.dataType, (*path, f.name)).items()}
    return {path: t}


def _list_paths(t: T.DataType, path: Path = ()) -> list[Path]:
    if isinstance(t, T.ArrayType):
        return [path, *_list_paths(t.elementType, path)]
    if isinstance(t, T.StructType):
        return [p for f in t.fields for p in _list_paths(f.dataType, (*path, f.name))]
    return []


# --- payloads of several layouts -> one nested schema -------------------------------------------------

LINK = T.StructType([T.StructField(x, T.StringType()) for x in ("link_order", "link_key", "href", "link_text", "filename")])
ITEM = T.StructType([T.StructField(x, T.StringType()) for x in ("item_id", "parent_item_id", "item_order", "item_name")] + [T.StructField("links", T.ArrayType(LINK))])
CATEGORIES = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("category_id", "category_order", "category_name")] + [T.StructField("items", T.ArrayType(ITEM))]))


def _snake(key: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m.group(1), key).lower()


def _text(x: object) -> str | None:
    """Scalars as the typed table stores them: whole floats without their point."""
    if x is None or isinstance(x, (dict, list)):
        return None
    if isinstance(x, bool):
        return str(x).lower()
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def _records(x: object, id_key: str) -> list[dict]:
    """A list, one record, a mapping of id to record, or any of these as a JSON string."""
    if isinstance(x, str):
        try:
            x = json.loads(x)
        except ValueError:
            return []
    if isinstance(x, dict):
        own = {_snake(k) for k in x}
        prefix = id_key.rpartition("_")[0]
        if any(k == "items" or k.startswith(prefix + "_") for k in own):
            x = [x]
        else:
            x = [{id_key: k, **v} for k, v in x.items() if isinstance(v, dict)]
    if not isinstance(x, list):
        return []
    return [{_snake(k): v for k, v in r.items()} for r in x if isinstance(r, dict)]


def _items(x: object, parent: str | None, out: list[dict]) -> list[dict]:
    todo = [(r, parent) for r in reversed(_records(x, "item_id"))]
    while todo:
        r, up = todo.pop()
        iid = _text(r.get("item_id"))
        links = [
            {"link_order": _text(q.get("order", q.get("link_order"))), "link_key": _text(q.get("unique", q.get("link_key"))), "href": _text(q.get("href")), "link_text": _text(q.get("text", q.get("link_text"))), "filename": _text(q.get("filename"))}
            for q in _records(r.get("links"), "link_key")
        ]
        out.append({"item_id": iid, "parent_item_id": up, "item_order": _text(r.get("item_order")), "item_name": _text(r.get("item_name")), "links": links})
        for k in ("sub_items", "items", "children"):
            todo.extend((q, iid) for q in reversed(_records(r.get(k), "item_id")))
    return out


def payload_categories(payload: str | None) -> list[dict] | None:
    """The categories of one scraped payload in the schema CATEGORIES; None for an unreadable payload."""
    if payload is None:
        return None
    try:
        o = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    for _ in range(3):
        if not isinstance(o, dict) or "categories" in o:
            break
        o = next((v for v in o.values() if isinstance(v, dict)), None)
    if not isinstance(o, dict):
        return []
    return [
        {"category_id": _text(c.get("category_id")), "category_order": _text(c.get("category_order")), "category_name": _text(c.get("category_name")), "items": _items(c.get("items"), None, [])}
        for c in _records(o.get("categories"), "category_id")
    ]


def parse_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with `categories` (schema CATEGORIES) and `readable` in place of the payload column.

    Layouts: camelCase or snake_case keys; the meeting wrapped in an object; categories or items as a list, a single
    object, a mapping keyed by id, or a JSON string; items below items (they keep parent_item_id). Null, damaged
    or truncated payloads give null categories and readable = false.
    """
    keep = [c for c in df.columns if c != payload]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("categories", CATEGORIES), T.StructField("readable", T.BooleanType())])
    arrow = to_arrow_type(CATEGORIES)
    src = df.select(*keep, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cats = [payload_categories(p) for p in b.column(len(keep)).to_pylist()]
            cols = [b.column(k) for k in range(len(keep))] + [pa.array(cats, arrow), pa.array([c is not None for c in cats])]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def categories_table(df: DataFrame, keep: list[str]) -> DataFrame:
    return flat_table(df, "categories", (), keep, {"category_id": "category_id", "category_order": "category_order", "category_name": "category_name"})


def items_table(df: DataFrame, keep: list[str]) -> DataFrame:
    fields = [f.name for f in df.schema["categories"].dataType.elementType["items"].dataType.elementType.fields if f.name != "links"]
    return flat_table(df, "categories", ("items",), keep, {"category_id": "category_id"} | {f"items/{x}": x for x in fields})


def links_table(df: DataFrame, keep: list[str]) -> DataFrame:
    fields = [f.name for f in LINK.fields]
    return flat_table(df, "categories", ("items", "links"), keep, {"category_id": "category_id", "items/item_id": "item_id"} | {f"items/links/{x}": x for x in fields})
