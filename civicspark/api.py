"""The library's entry point: document listing and batches of questions, as DataFrames."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.operators import relational, retrieval
from civicspark.plugins import Embedder, HashingEmbedder, embed

#: Bounds of a request.
MAX_TOP_K, MAX_QUERY = 25, 2000
DEFAULT_EXCLUDED = ["research_analysis"]


class Records:
    """documents: as document_records; chunks: chunk_id, document_id, tenant_id, document_type, content, title, meeting_date."""

    def __init__(self, documents: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, embedder: type[Embedder] = HashingEmbedder) -> None:
        self.documents, self.chunks, self.vectors, self.embedder = documents, chunks, vectors, embedder

    def list_documents(self, tenant_id: str, document_type: str | None = None, title: str | None = None, date_from: datetime.date | None = None, date_to: datetime.date | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of a tenant's documents with their number of chunks: latest first, unknown dates last."""
        d = relational.where_given(relational.tenant(self.documents, tenant_id), document_type=document_type)
        d = relational.between(d, "meeting_date", date_from, date_to)
        d = d.where(relational.containing(F.col("title"), title)) if title else d
        d = relational.page(d.select("id", "title", "document_type", "meeting_date", "committee_name"), [F.desc_nulls_last("meeting_date"), F.asc_nulls_last("title"), F.col("id")], limit, offset)
        return relational.with_child_count(d, self.chunks, "id", "document_id", "n_chunks")

    def count_documents(self, tenant_id: str, document_type: str | None = None) -> DataFrame:
        return relational.where_given(relational.tenant(self.documents, tenant_id), document_type=document_type).agg(F.count("*").alias("total"))

    def document(self, document_id: str) -> DataFrame:
        return relational.with_child_count(self.documents.where(F.col("id") == document_id), self.chunks, "id", "document_id", "n_chunks")

    def ask(self, questions: DataFrame, tenant_id: str, mode: str = "hybrid", top_k: int = 10, names: DataFrame | None = None, excluded: list[str] | None = None, document_type: str | None = None, date_from: datetime.date | None = None, date_to: datetime.date | None = None, today: datetime.date | None = None, recency_weight: float = 0.3, rescored: bool = False) -> DataFrame:
        """(query_id, source_number, chunk_id, title, meeting_date, content, score) for questions (query_id, text) of one tenant.

        mode: hybrid, vector or keyword; names (query_id, name) add a name leg to hybrid. Filters hold for every leg and
        before any cut to k. Recency counts only if no date is asked for. A question without a hit has no row. Texts are refused
        when empty or longer than MAX_QUERY, top_k outside 1 to MAX_TOP_K.
        """
        if mode not in ("hybrid", "vector", "keyword"):
            raise ValueError(f"unknown mode {mode}")
        if not 1 <= top_k <= MAX_TOP_K:
            raise ValueError("top_k is out of bounds")
        if not questions.where(f"text is null or trim(text) = '' or length(text) > {MAX_QUERY}").isEmpty():
            raise ValueError("a question is empty or too long")
        c = relational.excluding(relational.tenant(self.chunks, tenant_id), "document_type", DEFAULT_EXCLUDED if excluded is None else excluded)
        c = relational.between(relational.where_given(c, document_type=document_type), "meeting_date", date_from, date_to)
        wide = max(top_k, 20)
        legs: dict[str, DataFrame] = {}
        if mode in ("hybrid", "keyword"):
            post = retrieval.postings(c, "chunk_id", "content", questions)
            legs["keyword"] = retrieval.top_k(retrieval.cover_density(post, questions, "chunk_id"), wide, "chunk_id")
        if mode in ("hybrid", "vector"):
            v = embed(c, "chunk_id", "content", self.embedder) if self.vectors is None else self.vectors.join(c.select("chunk_id"), "chunk_id", "left_semi")
            q = embed(questions, "query_id", "text", self.embedder)
            legs["vector"] = retrieval.knn(v, q, wide, "chunk_id")
        if mode == "hybrid" and names is not None:
            legs["name"] = retrieval.name_hits(c, names, "chunk_id", "content", "meeting_date", wide)
        fused = retrieval.fuse(legs, "chunk_id").join(c.select("chunk_id", "title", "meeting_date", "content"), "chunk_id")
        weight = recency_weight if date_from is None and date_to is None else 0.0
        hits = retrieval.with_recency(fused, "meeting_date", today or datetime.date.today(), weight)
        if rescored:
            hits = retrieval.rescore(hits.join(questions, "query_id"), "text", "content", "chunk_id", top_k)
        else:
            hits = retrieval.top_k(hits, top_k, "chunk_id")
        return retrieval.citations(hits, "chunk_id").select("query_id", "source_number", "chunk_id", "title", "meeting_date", "content", "score")
