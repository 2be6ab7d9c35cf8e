"""Batches of questions answered by hybrid retrieval, as one lazy plan.

Legs (vector, full text, names) give (query_id, chunk_id, score); they are united and aggregated by chunk (no chain of full
joins), adjusted by recency, optionally rescored on a small pool, and cut to k per query by a limited window.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with"]


# --- full text -----------------------------------------------------------------------------------------


Terms = Callable[[Column], Column]

#: Scripts written without spaces between words: each character is a term.
_ALONE = r"([\u3040-\u30ff\u3400-\u9fff])"


def terms(text: Column, stop: bool = True) -> Column:
    """Lower-case word terms of any script in order (kana and ideographs one by one), stop words dropped."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "), _ALONE, " $1 ")
    t = F.filter(F.split(apart, " "), lambda x: x != "")
    return F.filter(t, lambda x: ~x.isin(STOPWORDS)) if stop else t


def plural_stem(term: Column) -> Column:
    """The published S-stemmer for English: -ies to -y (not -eies, -aies), -es to -e (not -aes, -ees, -oes), -s off (not -us, -ss); words of three letters stay."""
    cut = lambda n: F.left(term, F.length(term) - n)
    ends = lambda *e: F.lit(False) if not e else reduce(lambda a, b: a | b, [term.endswith(x) for x in e])
    short = F.length(term) <= 3
    return (
        F.when(short, term).when(ends("ies") & ~ends("eies", "aies"), F.concat(cut(3), F.lit("y"))).when(ends("es") & ~ends("aes", "ees", "oes"), cut(1))
        .when(ends("s") & ~ends("us", "ss"), cut(1)).otherwise(term)
    )


def stemmed_terms(text: Column) -> Column:
    """Terms under plural_stem; another stemmer is another function of this kind."""
    return F.transform(terms(text), plural_stem)


def postings(docs: DataFrame, key: str, text: str, queries: DataFrame | None = None, terms: Terms = terms) -> DataFrame:
    """(term, key, positions, tf); `textindex.build` stores them.

    With `queries`, only their terms are kept, before anything is shuffled: what a batch of questions needs without an index.
    """
    p = docs.select(key, F.posexplode(terms(F.col(text))).alias("pos", "term"))
    if queries is not None:
        p = p.join(query_terms(queries, terms=terms).select("term").distinct(), "term", "left_semi")
    return p.groupBy("term", key).agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count("*").alias("tf"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text", terms: Terms = terms) -> DataFrame:
    q = queries.select(query_id, F.array_distinct(terms(F.col(text))).alias("ts"))
    return q.select(query_id, F.size("ts").alias("n_terms"), F.explode("ts").alias("term"))


def match_all(post: DataFrame, queries: DataFrame, key: str, terms: Terms = terms) -> DataFrame:
    """(query_id, key, tf): documents with every term of the query; tf is the number of occurrences of all."""
    hit = query_terms(queries, terms=terms).join(post.select("term", key, "tf"), "term")
    g = hit.groupBy("query_id", key).agg(F.count("*").alias("found"), F.max("n_terms").alias("n_terms"), F.sum("tf").alias("tf"))
    return g.where("found = n_terms").select("query_id", key, "tf")


def match_phrase(post: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query_id, key, hits): documents in which the query's terms stand in order without a gap (stop words do not count)."""
    q = queries.select("query_id", F.posexplode(terms(F.col("text"))).alias("at", "term"), F.size(terms(F.col("text"))).alias("n_terms"))
    starts = q.join(post.select("term", key, F.explode("positions").alias("pos")), "term").groupBy("query_id", key, (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("found"), F.max("n_terms").alias("n"))
    return starts.where("found = n").groupBy("query_id", key).agg(F.count("*").alias("hits"))


def bm25(post: DataFrame, lengths: DataFrame, queries: DataFrame, key: str, k1: float = 1.2, b: float = 0.75, need_all: bool = False) -> DataFrame:
    """(query_id, key, score); lengths: (key, dl) of every text, as an index holds it."""
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hit = query_terms(queries).join(post, "term")
    df = query_terms(queries).select("term").distinct().join(post, "term").groupBy("term").agg(F.count("*").alias("df"))
    x = hit.join(df, "term").join(lengths, key).join(stats)
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    g = x.groupBy("query_id", key).agg(F.sum(part).alias("score"), F.count("*").alias("found"), F.max("n_terms").alias("n_terms"))
    return (g.where("found = n_terms") if need_all else g).select("query_id", key, "score")


def cover_density(post: DataFrame, queries: DataFrame, key: str, weight: float = 0.1) -> DataFrame:
    """(query_id, key, score): the sum over minimal covers (shortest stretches with every term) of weight / length.

    For each occurrence that ends a stretch, the latest start is the least of the terms' last positions so far; it is a minimal
    cover where it differs from the stretch before.
    """
    hits = query_terms(queries).join(post.select("term", key, F.explode("positions").alias("pos")), "term")
    g = hits.groupBy("query_id", key).agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("o"), F.count_distinct("term").alias("found"), F.max("n_terms").alias("n_terms")).where("found = n_terms")
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("seen"), F.lit(-1).alias("prev"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.map_concat(F.map_filter(acc["seen"], lambda k, _: k != x["term"]), F.create_map(x["term"], x["pos"]))
        low = F.array_min(F.map_values(seen))
        full = (F.size(seen) == F.col("n_terms")) & (low > acc["prev"])
        return F.struct(seen.alias("seen"), F.when(full, low).otherwise(acc["prev"]).alias("prev"), (acc["score"] + F.when(full, weight / (x["pos"] - low + 1)).otherwise(0.0)).alias("score"))

    return g.select("query_id", key, F.aggregate("o", start, step)["score"].alias("score"))


#: Names of a batch that are sought one after another by the engine; more are sought all at once by an automaton.
NAMES_IN_TURN = 64


def _names_in(docs: DataFrame, text: str, needles: list[str]) -> DataFrame:
    """docs without its text, a row for each needle that the text contains; both are in lower case."""
    keep = [c for c in docs.columns if c != text]
    if len(needles) <= NAMES_IN_TURN:
        found = F.filter(F.array(*map(F.lit, needles)).cast("array<string>"), lambda n: F.contains(F.col(text), n))
        return docs.withColumn("needle", found).where(F.size("needle") > 0).select(*keep, F.explode("needle").alias("needle"))
    held = docs.sparkSession.sparkContext.broadcast(needles)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("needle", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for n in held.value:
            a.add_word(n, n)
        a.make_automaton()
        for b in batches:
            at, hits = [], []
            for i, t in enumerate(b.column(len(keep)).to_pylist()):
                for n in {n for _, n in a.iter(t)} if t else ():
                    at.append(i)
                    hits.append(n)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))), pa.array(hits, pa.string())], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def name_hits(docs: DataFrame, names: DataFrame, key: str, text: str, date: str, k: int) -> DataFrame:
    """(query_id, key, score = 1.0): the k latest documents of each name, a document once per query.

    names: query_id, name, a batch of questions' names (they are held by every task). A name is a literal part of the text in
    any case, wherever it stands, also within a word; null and blank names find nothing.
    """
    n = names.select("query_id", "name", F.lower("name").alias("needle")).where("trim(name) <> ''")
    needles = sorted({r[0] for r in n.select("needle").distinct().toLocalIterator()})
    d = docs.select(key, F.lower(F.col(text)).alias("__text"), F.col(date).alias("__date"))
    hit = _names_in(d, "__text", needles).join(F.broadcast(n) if len(needles) <= NAMES_IN_TURN else n, "needle")
    w = Window.partitionBy("query_id", "name").orderBy(F.desc_nulls_last("__date"), key)
    top = hit.select("query_id", "name", key, "__date").distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.select("query_id", key).distinct().withColumn("score", F.lit(1.0))


# --- vectors -------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def mean_pool(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """(group, vector): the normalised mean of a group's vectors; vectors of another length are left out.

    Every task sums its vectors by group first, so what is exploded and shuffled is one vector per task and group.
    """
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        names = None
        for b in batches:
            names = b.column(0).type
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, dim)
            keys = b.column(0).dictionary_encode()
            at = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            for i, k in enumerate([*keys.dictionary.to_pylist(), None]):
                mine = x[at == i]
                if len(mine):
                    s, n = sums.get(k, (0.0, 0))
                    sums[k] = (s + mine.sum(0), n + len(mine))
            if len(sums) > 10_000:
                yield _sums(sums, names)
                sums = {}
        if sums:
            yield _sums(sums, names)

    def _sums(sums: dict, names: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), names), pa.array([s.tolist() for s, _ in sums.values()], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()], pa.int64())], names=["g", "s", "n"])

    part = df.where(F.size(vector) == dim).select(group, vector).mapInArrow(run, f"g {kind}, s array<double>, n bigint").withColumnRenamed("g", group)
    x = part.select(group, "n", F.posexplode("s").alias("i", "x"))
    m = x.groupBy(group, "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    v = m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    return v.select(group, unit(F.col("v")).alias(vector))


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, batch: int = 20_000) -> DataFrame:
    """(query_id, key, score) of the k nearest by cosine, for a stated set of queries, exact.

    Scores are rounded to nine places and ties go to the least key, within a partition as in the end. The queries are worked
    through in batches of `batch`, each one matrix: every partition multiplies its vectors with it in blocks and keeps k per
    query, and the partitions' tops are merged.
    """
    rows, parts = queries.select("query_id", vector).toLocalIterator(), []
    while (q := list(islice(rows, batch))) or not parts:
        parts.append(_knn_part(vectors, queries, q, k, key, vector))
    return top_k(reduce(DataFrame.union, parts), k, key)


def _nearest(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores of each row, of equal ones the first; NaN is the greatest, as in the engine's order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    s = np.where(np.isnan(scores), np.inf, scores)
    last = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    above, equal = s > last, s == last
    take = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(s), k)


def _knn_part(vectors: DataFrame, queries: DataFrame, q: list, k: int, key: str, vector: str) -> DataFrame:
    ids = [r[0] for r in q]
    m = np.array([r[1] for r in q], np.float64).reshape(len(q), -1) if q else np.empty((0, 0))
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    held = vectors.sparkSession.sparkContext.broadcast((ids, m))
    id_type, q_type = dict(vectors.dtypes)[key], dict(queries.dtypes)["query_id"]
    id_arrow, q_arrow = to_arrow_type(vectors.schema[key].dataType), to_arrow_type(queries.schema["query_id"].dataType)
    in_order = lambda x: (x is not None, x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = held.value
        best_s, best_k = np.empty((len(ids), 0)), np.empty((len(ids), 0), object)
        step = max(k, 4_000_000 // max(len(ids), 1))
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                v = b.column(1)
                ok = pc.fill_null(pc.equal(pc.list_value_length(v), m.shape[1]), False)
                if not len(ids) or not pc.any(ok).as_py():
                    continue
                b = b.filter(ok)
                x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                names = b.column(0).to_pylist()
                order = sorted(range(len(names)), key=lambda i: in_order(names[i]))
                s = np.round(m @ x[order].T, 9)
                top = _nearest(s, k)
                new = np.empty(len(names), object)
                new[:] = [names[i] for i in order]
                s, near = np.concatenate((best_s, np.take_along_axis(s, top, 1)), axis=1), np.concatenate((best_k, new[top]), axis=1)
                at = {n: i for i, n in enumerate(sorted(set(near.ravel().tolist()), key=in_order))}
                code = np.array([at[n] for n in near.ravel().tolist()]).reshape(near.shape)
                by_key = np.argsort(code, axis=1, kind="stable")
                s, near = np.take_along_axis(s, by_key, 1), np.take_along_axis(near, by_key, 1)
                top = _nearest(s, k)
                best_s, best_k = np.take_along_axis(s, top, 1), np.take_along_axis(near, top, 1)
        n = best_s.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([i for i in ids for _ in range(n)], q_arrow), pa.array(best_k.ravel().tolist(), id_arrow), pa.array(best_s.ravel())], names=["query_id", key, "score"])

    part = vectors.select(key, vector).mapInArrow(run, f"query_id {q_type}, {key} {id_type}, score double")
    return part.withColumn("score", F.round("score", 9))


def top_k(hits: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- fusion --------------------------------------------------------------------------------------------


def fuse(legs: dict[str, DataFrame], key: str, constant: int = 60) -> DataFrame:
    """(query_id, key, rrf_score, source_ranks, source_scores): the sum of 1 / (constant + rank) over legs of (query_id, key, score)."""
    ranked = []
    for name, leg in legs.items():
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
        ranked.append(leg.select("query_id", key, F.col("score").cast("double").alias("score"), F.lit(name).alias("leg"), F.row_number().over(w).alias("rank")))
    u = reduce(DataFrame.union, ranked)
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("leg", c))))
    return u.groupBy("query_id", key).agg(F.sum(1 / (constant + F.col("rank"))).alias("rrf_score"), entries("rank").alias("source_ranks"), entries("score").alias("source_scores"))


def recency(date: Column, today: datetime.date, half_life: int = 365) -> Column:
    """Half-life decay by age: 1 for the future, 0.5 for an unknown date."""
    age = F.datediff(F.lit(today), date)
    return F.when(date.isNull(), 0.5).when(age < 0, 1.0).otherwise(F.pow(F.lit(0.5), age / half_life))


def with_recency(fused: DataFrame, date: str, today: datetime.date, weight: float = 0.3) -> DataFrame:
    """score = rrf_score * (1 + weight * recency); weight 0 leaves the score."""
    return fused.withColumn("score", F.col("rrf_score") * (1 + weight * recency(F.col(date), today)) if weight > 0 else F.col("rrf_score"))


def with_authority(hits: DataFrame, kind: str, weights: dict[str, float]) -> DataFrame:
    """Optional: the score times a weight by document type (1 for others)."""
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return hits.withColumn("score", F.col("score") * F.coalesce(F.try_element_at(m, F.coalesce(F.col(kind), F.lit(""))), F.lit(1.0)))


def overlap_score(query: Column, text: Column) -> Column:
    """Default scorer of the rescoring pool: the share of the query's terms that the text has."""
    q = F.array_distinct(terms(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, F.array_distinct(terms(text)))), F.size(q)), F.lit(0.0))


def rescore(hits: DataFrame, query: str, text: str, key: str, k: int, scorer: object = overlap_score) -> DataFrame:
    """The first max(2k, 20) hits of each query with the scorer's score instead, cut to k. scorer: Columns (query, text) to Column."""
    pool = top_k(hits, max(2 * k, 20), key).drop("rank")
    return top_k(pool.withColumn("score", scorer(F.col(query), F.col(text))), k, key)


def citations(hits: DataFrame, key: str) -> DataFrame:
    """source_number per query and the score rounded to four places."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return hits.withColumn("source_number", F.row_number().over(w)).withColumn("score", F.round("score", 4))


def context_blocks(cited: DataFrame, title: str, date: str, text: str, committee: str | None = None, url: str | None = None) -> DataFrame:
    """(query_id, context): the cited texts in order, each under its number and the lines of its header that say something, rules between them."""
    said = lambda name, c: F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
    lines = [said(n, c) for n, c in (("Title", title), ("Date", date), ("Committee", committee), ("URL", url)) if c]
    head = F.concat_ws("\n", F.concat(F.lit("[Source "), F.col("source_number").cast("string"), F.lit("]")), *lines)
    block = F.concat(head, F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")))
    g = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_number", block.alias("b")))).alias("bs"))
    return g.select("query_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def route(question: Column, threshold: float = 0.7) -> Column:
    """Rule-based default router: 'database' for counting questions, 'hybrid' if they also ask why or how, else 'rag'."""
    q = F.lower(question)
    counts, reasons = q.rlike(r"\b(how many|count|number of|list all|total)\b"), q.rlike(r"\b(why|how did|explain|discuss)")
    confidence = F.when(counts & reasons, 0.75).when(counts, 0.9).otherwise(0.6)
    return F.when(confidence < threshold, "rag").when(counts & reasons, "hybrid").when(counts, "database").otherwise("rag")


def extractive_answer(cited: DataFrame, text: str, most: int = 3) -> DataFrame:
    """(query_id, answer): the first sentence of the best sources with their numbers; what stands in for a text model.

    Questions without a hit are to be answered by NO_INFORMATION (left join them).
    """
    first = F.get(F.split(F.regexp_replace(F.col(text), r"^\s+", ""), r"(?<=[.!?])\s+"), F.lit(0))
    line = F.concat(first, F.lit(" [Source "), F.col("source_number").cast("string"), F.lit("]"))
    g = cited.where(F.col("source_number") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_number", line.alias("l")))).alias("ls"))
    return g.select("query_id", F.array_join(F.transform("ls", lambda x: x["l"]), " ").alias("answer"))


NO_INFORMATION = "No record was found that answers this."
