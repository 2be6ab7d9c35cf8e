"""Groups of slightly edited copies, by sharded BK-trees over bit sketches and an exact check of every link.

1. Words (case and layout left out) give runs of three; a text's sketch is one bit of each of 64 minima under random
   orders of its runs, so that the Hamming distance of two sketches is about 32 * (1 - Jaccard similarity).
2. BK-trees over the sketches (children keyed by the distance to their parent) return all sketches within a radius. The
   radius that a similarity of one half needs (24 of 64) is close to the distance of unrelated texts (32), where a tree
   over all sketches prunes next to nothing and could not be broadcast either; so the trees are sharded: texts go
   to the shards of 48 bands of four minima each, and a tree holds one shard. See the README.
3. Each tree gives the nearest link to every other group of its shard, never all pairs; links of all shards are checked by
   exact Jaccard similarity of the runs of three, and connected components of the confirmed links are the groups.
4. A link that the check rejects may have kept a true one back, so shards that gave one are searched again: there each
   text gives its nearest hits outside its confirmed group, eight first, then 64, then all, until none is left out.
5. A shard beyond SHARD_ROWS is split into parts of about that size, each with its own tree. First every part is searched by
   itself and the first part by all others, which joins the copies of one text. Then only texts outside the shard's largest
   confirmed group ask all trees, in chunks of about SHARD_ROWS, as in step 4. Work thus grows with the rows of a shard
   that copies have filled, and with the texts outside times the rows of the shard at worst.

Copies that are equal but for case and layout are one node from the start, so a group of copies with a third of all rows
is pre-aggregated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.runs import key_runs
from civicspark.operators.graph import connected_components
from civicspark.session import cut

WORDS = 3
THRESHOLD = 0.5
BANDS, ROWS = 48, 4
RADIUS = 24
#: Rows of a shard that one tree holds; larger shards are split, and a task gets one tree and as many queries at a time.
SHARD_ROWS = 4096
#: Shards are sized by counting one node in SAMPLE_NODES; this decides only how they are split.
SAMPLE_NODES = 128
#: Rows of a key set up to which it is broadcast.
BROADCAST_ROWS = 500_000
BLOCK = 1 << 15
#: Nearest hits of each text that the searches after the first give (None: all).
AGAIN = (8, 64, None)

_UNIT = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def words(text: str) -> list[str]:
    return _UNIT.findall(text.lower())


class Hasher:
    """Word hashes, kept between texts."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, ws: list[str]) -> list[int]:
        try:
            return [self.known[w] for w in ws]
        except KeyError:
            if len(self.known) > self.most:
                self.known.clear()
            for w in ws:
                if w not in self.known:
                    self.known[w] = xxhash.xxh3_64_intdigest(w)
            return [self.known[w] for w in ws]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX[6]
    return h ^ (h >> np.uint64(32))


def shingles(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of the runs of n words; fewer words are one run."""
    if len(h) < n:
        h = np.concatenate((h, np.zeros(n - len(h), np.uint64)))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        s += h[k : len(h) - n + 1 + k] * _MIX[k]
    return _finish(s)


def signatures(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys [texts, BANDS] int64, sketches int64)."""
    n = len(runs)
    minima = np.empty((BANDS * ROWS, n), np.uint32)
    size = np.array([len(r) for r in runs])
    at = 0
    while at < n:
        stop = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), BLOCK, side="right")))
        x = (np.concatenate(runs[at:stop]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum(size[at:stop])[:-1]))
        for k in range(BANDS * ROWS):
            minima[k, at:stop] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], starts)
        at = stop
    bits = ((minima[:64] >> np.uint32(11)) & np.uint32(1)).astype(np.uint64)
    sketch = (bits << np.arange(64, dtype=np.uint64)[:, None]).sum(0, dtype=np.uint64)
    keys = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(n, b + 1, np.uint64)
        for r in range(ROWS):
            h = _finish(h * _MIX[5] + minima[b * ROWS + r])
        keys[:, b] = h
    return keys.view(np.int64), sketch.view(np.int64)


class BKTree:
    """Sketches by Hamming distance: a child's key is its distance to the parent."""

    def __init__(self) -> None:
        self.sketch: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, s: int) -> int:
        new = len(self.sketch)
        at = 0
        while new:
            d = (self.sketch[at] ^ s).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        self.sketch.append(s)
        self.children.append({})
        return new

    def within(self, s: int, radius: int) -> list[tuple[int, int]]:
        """(distance, position) of all sketches within the radius; only edges whose key can lead there are followed."""
        out, todo = [], [0] if self.sketch else []
        while todo:
            at = todo.pop()
            d = (self.sketch[at] ^ s).bit_count()
            if d <= radius:
                out.append((d, at))
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return out


#: What a text does in a shard's task: both, stand in the tree only, or ask only.
BOTH, HELD, ASKING = 0, 1, 2


def shard_links(nodes: list[int], sketches: list[int], roles: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """The nearest link from each asking text to every group of the shard that it is not yet joined with."""
    tree, order, root = BKTree(), [], {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for asking in (False, True):
        for n, s, role in zip(nodes, sketches, roles, strict=True):
            if (role == ASKING) is not asking:
                continue
            for _, k in sorted(tree.within(s, radius)) if role != HELD else ():
                a, b = find(n), find(order[k])
                if a != b:
                    root[a] = b
                    out.append((n, order[k]))
            if role != ASKING:
                tree.add(s)
                order.append(n)
    return out


def open_hits(nodes: list[int], sketches: list[int], roles: list[int], groups: list[int], most: int | None, radius: int = RADIUS) -> tuple[list[tuple[int, int]], bool]:
    """The `most` nearest hits (None: all) from each asking text to texts of other groups, and whether any were left out."""
    tree, at, out, left_out = BKTree(), [], [], False
    for asking in (False, True):
        for i, role in enumerate(roles):
            if (role == ASKING) is not asking:
                continue
            if role != HELD:
                hits = [at[k] for _, k in sorted(tree.within(sketches[i], radius)) if groups[at[k]] != groups[i]]
                left_out |= most is not None and len(hits) > most
                out += [(nodes[i], nodes[k]) for k in hits[:most]]
            if role != ASKING:
                tree.add(sketches[i])
                at.append(i)
    return out, left_out


def fingerprints(df: DataFrame, id_col: str, text: str, table_name: str) -> DataFrame:
    """(table_name, id, node, sketch, bands) of every text with a word; node is equal for texts equal but for case and layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seed = Hasher(), xxhash.xxh3_64_intdigest(table_name)
        for b in batches:
            ids, runs, nodes = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(t) if t else None
                if ws:
                    h = np.array(hasher(ws), np.uint64)
                    ids.append(i)
                    runs.append(shingles(h))
                    nodes.append(xxhash.xxh3_64_intdigest(h.tobytes(), seed))
            if ids:
                keys, sketch = signatures(runs)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sketch), bands], names=["id", "node", "sketch", "bands"])

    kind = dict(df.dtypes)[id_col]
    got = df.select(id_col, text).where(F.col(id_col).isNotNull() & (F.length(text) > 0)).mapInArrow(run, f"id {kind}, node bigint, sketch bigint, bands array<bigint>")
    return got.select(F.lit(table_name).alias("table_name"), "*")


def _hinted(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hot_shards(reps: DataFrame, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE_NODES) -> DataFrame:
    """(band, parts) of the shards of more than shard_rows texts, sized by one node in `sample`."""
    some = reps.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(sample)) == 0)
    size = some.select(F.explode("bands").alias("band")).groupBy("band").count().where(F.col("count") * sample > shard_rows)
    return size.select("band", F.ceil(F.col("count") * sample / shard_rows).cast("int").alias("parts"))


def _part(of: str = "parts") -> Column:
    return F.pmod(F.xxhash64("node"), F.col(of)).cast("int")


def _cells(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """First search of split shards: each part by itself, and the first part's tree with each other part's queries."""
    split = rows.join(hot, "band").withColumn("part", _part())
    own = split.select(F.xxhash64("band", "part", "part").alias("cell"), "node", "sketch", "grp", F.lit(BOTH).alias("role"))
    asking = split.where("part > 0").select(F.xxhash64("band", F.lit(0), "part").alias("cell"), "node", "sketch", "grp", F.lit(ASKING).alias("role"))
    held = split.where("part = 0").withColumn("to", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)))
    return own.union(asking).union(held.select(F.xxhash64("band", F.lit(0), "to").alias("cell"), "node", "sketch", "grp", F.lit(HELD).alias("role")))


def _outside(rows: DataFrame, hot: DataFrame, shard_rows: int) -> DataFrame:
    """Later searches of split shards: texts outside a shard's largest group, in chunks, ask the trees of all parts."""
    split = rows.join(hot, "band")
    sizes = cut(split.groupBy("band", "grp").agg(F.count("*").alias("n")))
    total = sizes.groupBy("band").agg(F.max_by("grp", F.struct("n", "grp")).alias("most"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    total = total.select("band", "most", F.ceil(F.col("rest") / shard_rows).cast("int").alias("chunks"))
    split = split.join(total, "band").withColumn("part", _part())
    held = split.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select(F.xxhash64("band", "part", "chunk").alias("cell"), "node", "sketch", "grp", F.lit(HELD).alias("role"))
    asking = split.where("grp <> most").withColumn("chunk", _part("chunks")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return held.union(asking.select(F.xxhash64("band", "to", "chunk").alias("cell"), "node", "sketch", "grp", F.lit(ASKING).alias("role")))


def candidate_links(reps: DataFrame, hot: DataFrame, shard_rows: int = SHARD_ROWS, radius: int = RADIUS, again: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(a, b) with a < b, from the trees of all shards; reps has node, sketch and bands once per node, hot is of hot_shards.

    again: small shards to search once more, beside the split ones, for the `most` nearest hits of each text outside its
    group (reps then has grp); a row with a null b says that hits were left out.
    """
    first = again is None
    rows = reps.select(F.explode("bands").alias("band"), "node", "sketch", F.lit(0).cast("bigint").alias("grp") if first else "grp")
    small = rows if first else rows.join(_hinted(again), "band", "left_semi")
    if not hot.isEmpty():
        small = small.join(_hinted(hot), "band", "left_anti")
        split = _cells(rows, _hinted(hot)) if first else _outside(rows, _hinted(hot), shard_rows)
        rows = small.select(F.col("band").alias("cell"), "node", "sketch", "grp", F.lit(BOTH).alias("role")).union(split)
    else:
        rows = small.select(F.col("band").alias("cell"), "node", "sketch", "grp", F.lit(BOTH).alias("role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        left_out = False
        for r in key_runs(batches):
            _, nodes, sketches, groups, roles = (c.to_pylist() for c in r.columns)
            sketches = [s & 0xFFFFFFFFFFFFFFFF for s in sketches]
            if not first:
                hits, more = open_hits(nodes, sketches, roles, groups, most, radius)
                out += hits
                left_out |= more
            else:
                out += shard_links(nodes, sketches, roles, radius)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)
        if left_out:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([None], pa.int64())], names=["a", "b"])

    return rows.repartition(F.col("cell")).sortWithinPartitions("cell", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    p = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(p.min(1) if len(p) else p[:, 0]), pa.array(p.max(1) if len(p) else p[:, 0])], names=["a", "b"])


def jaccard(a: str, b: str, hasher: Hasher, n: int = WORDS) -> float:
    x, y = (np.unique(shingles(np.array(hasher(words(t)), np.uint64), n)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _checked(links: DataFrame, members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ok) of the links: whether the texts have more than `threshold` of their runs in common."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    rep_ids = _hinted(members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("table_name", "id")).alias("r")).select("node", "r.*"))
    held = cut(texts.where("text is not null").join(rep_ids, ["table_name", "id"]).dropDuplicates(["node"]).select("node", "text"))
    pairs = links.join(held.toDF("a", "text_a"), "a").join(held.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ok = [jaccard(x, y, hasher) > threshold for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return cut(pairs.mapInArrow(check, "a bigint, b bigint, ok boolean"))


def edited_copies(tables: dict[str, tuple[DataFrame, str, str]], threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, radius: int = RADIUS, sample: int = SAMPLE_NODES) -> DataFrame:
    """(table_name, id, group_id, n_texts): a row for every id with a text of a word or more.

    tables: name to (table, id column, text column). Texts are in one group when a chain of pairs joins them, each equal but
    for case and layout or with more than `threshold` of the runs of three words in either text in common. group_id
    is one number per group of the table; n_texts counts the group's different texts (1 for a text on its own or with
    equal copies only). Null ids and null, empty and wordless texts have no row; rows repeated for an id count
    once; texts of fewer than three words are one run. Tables are never compared with each other.
    """
    prints, texts = None, None
    for name, (df, id_col, text) in tables.items():
        p = fingerprints(df, id_col, text, name)
        t = df.select(F.lit(name).alias("table_name"), F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
        p = p.withColumn("id", F.col("id").cast("string"))
        prints, texts = (p, t) if prints is None else (prints.union(p), texts.union(t))
    prints = cut(prints)
    members = prints.select("table_name", "id", "node").distinct()
    reps = prints.select("node", "sketch", "bands").dropDuplicates(["node"])
    hot = cut(hot_shards(reps, shard_rows, sample))
    links = cut(candidate_links(reps, hot, shard_rows, radius))
    checked = _checked(links, members, texts, threshold)
    groups = connected_components(checked.where("ok"))
    split = not hot.isEmpty()
    false = checked.where("not ok")
    for most in AGAIN:
        if not split and false.isEmpty():
            break
        bands = reps.select("node", "bands")
        shared = false.join(bands.toDF("a", "x"), "a").join(bands.toDF("b", "y"), "b").select(F.explode(F.array_intersect("x", "y")).alias("band")).distinct()
        grouped = reps.join(groups, "node", "left").select("node", "sketch", "bands", F.coalesce("component", "node").alias("grp"))
        found = cut(candidate_links(grouped, hot, shard_rows, radius, shared, most))
        done = found.where("b is null").isEmpty()
        new = cut(found.where("b is not null").join(checked.select("a", "b"), ["a", "b"], "left_anti"))
        if not new.isEmpty():
            checked = checked.union(_checked(new, members, texts, threshold))
            groups = connected_components(checked.where("ok"))
        if done:
            break
        false = checked.where("not ok")
    groups = cut(groups.withColumnRenamed("component", "group_id"))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n_texts"))
    out = members.join(groups.join(sizes, "group_id"), "node", "left")
    return out.select("table_name", "id", F.coalesce("group_id", "node").alias("group_id"), F.coalesce("n_texts", F.lit(1).cast("bigint")).alias("n_texts"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(table_name, id_a, id_b): all pairs of different ids within a group, the smaller id first."""
    g = cut(groups.select("table_name", "group_id", "id").distinct())
    many = g.groupBy("table_name", "group_id").count().where("count > 1").drop("count")
    g = cut(g.join(many, ["table_name", "group_id"]))
    return g.withColumnRenamed("id", "id_a").join(g.withColumnRenamed("id", "id_b"), ["table_name", "group_id"]).where("id_a < id_b").select("table_name", "id_a", "id_b")
