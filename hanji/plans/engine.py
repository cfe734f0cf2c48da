"""Search and answering as one composed plan over an index, and the tools around it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanji import config
from hanji.functions import korean
from hanji.functions.text import article_number
from hanji.operators import grounding, index, retrieve, stores
from hanji.operators.vector_index import VectorIndex
from hanji.streaming.jobs import answer_events


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


def _checksums_of_bytes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0))
    return out


_OF_BYTE = _checksums_of_bytes()


def trigram_checksums(text: str) -> np.ndarray:
    """CRC-32 of the UTF-8 of each run of three characters, of a shorter text as a whole: a byte of all runs at a time."""
    data = np.frombuffer(text.encode(), np.uint8)
    begin = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    n = max(1, len(begin) - 3)
    first, size = begin[:n], begin[min(3, len(begin) - 1) :] - begin[:n]
    found = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(size.max()):
        some = np.flatnonzero(size > k) if size.min() <= k else slice(None)
        found[some] = _OF_BYTE[(found[some] ^ data[first[some] + k]) & 0xFF] ^ (found[some] >> 8)
    return found ^ np.uint32(0xFFFFFFFF)


class HashEmbedder:
    """Deterministic embeddings of hashed character trigrams; a stand-in where no model is installed."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            out[i] = np.bincount(trigram_checksums(t) % self.size, minlength=self.size)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of token states under an attention mask, scaled to length one."""
    m = mask[..., None].astype(hidden.dtype)
    pooled = (hidden * m).sum(1) / np.clip(m.sum(1), 1e-9, None)
    return pooled / np.clip(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12, None)


def vectors(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(doc_id, embedding) by an iterator over Arrow batches; the embedder travels once a task."""
    import pandas as pd

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "embedding": list(embedder.embed(b["text"].fillna("").tolist()))})

    return chunks.select("doc_id", "text").mapInPandas(work, "doc_id long, embedding array<float>")


class Model(Protocol):
    name: str

    def healthy(self) -> bool: ...

    def complete(self, messages: list[dict]) -> str: ...


def choose_model(primary: Model, fallbacks: list[Model]) -> Model:
    """The primary if healthy, else the first healthy fallback, else the primary."""
    return next((m for m in (primary, *fallbacks) if m.healthy()), primary)


@dataclass
class Engine:
    """Facade over a chunk table, its index and, optionally, vectors and a language model."""

    chunks: DataFrame
    idx: index.Index
    vecs: DataFrame | VectorIndex | None = None
    embedder: Embedder | None = None
    model: Model | None = None
    settings: config.Settings = field(default_factory=config.Settings)

    def search(self, query: str, k: int = 5, *, hybrid: bool = True, sort_by: str = "relevance", file_id=None, source=None) -> DataFrame:
        """Hits as rows of ``chunks`` with scores. Without ``hybrid`` only vectors count, and none of them means no hits."""
        query, k = retrieve.valid_query(query), retrieve.clamp_k(k)
        spark = self.chunks.sparkSession
        empty_vec = spark.createDataFrame([], "doc_id long, distance double")
        empty_bm25 = spark.createDataFrame([], "doc_id long, score double")
        vec = empty_vec
        if self.vecs is not None and self.embedder is not None:
            asked = [float(x) for x in self.embedder.embed([korean.vector_query(query)])[0]]
            vec = self.vecs.search(asked, 2 * k) if isinstance(self.vecs, VectorIndex) else retrieve.nearest(self.vecs, asked, 2 * k)
        bm25 = index.top(index.search(self.idx, self._terms(query)), 2 * k) if hybrid else empty_bm25
        return retrieve.hybrid(vec, bm25, self.chunks, k, sort_by=sort_by, file_id=file_id, source=source)

    @staticmethod
    def _terms(query: str) -> list[str]:
        import re

        from hanji.functions.text import TOKEN

        return list(dict.fromkeys(t for v in korean.variants(query) for t in re.findall(TOKEN, v.lower())))

    def retrieve(self, query: str) -> DataFrame:
        """The best chunks of all query variants, ranks fused, reranked; an article number goes straight to its chunks."""
        spark = self.chunks.sparkSession
        no = spark.range(1).select(article_number(F.lit(query)).alias("n")).first()["n"] if self.settings.retrieval.article_fast_path else None
        if no:
            hits = retrieve.article_fast_path(self.chunks, no, top_k=self.settings.retrieval.top_k)
            if not hits.isEmpty():
                return retrieve.rerank(hits, query, top_k=self.settings.retrieval.rerank_top_k)
        found = None
        for v, q in enumerate(korean.query_variants(query, hyde=self.settings.retrieval.hyde)):
            if len(q) < config.MIN_QUERY or len(q) > config.MAX_QUERY:
                continue
            hits = self.search(q, self.settings.retrieval.top_k).select("doc_id", "score").withColumn("variant", F.lit(v))
            found = hits if found is None else found.unionByName(hits)
        fused = retrieve.rank_fusion(found, top_k=self.settings.retrieval.top_k).withColumnRenamed("rrf", "score")
        return retrieve.rerank(self.chunks.join(F.broadcast(fused), "doc_id"), query, top_k=self.settings.retrieval.rerank_top_k)

    def context(self, query: str) -> DataFrame:
        """(rank, doc_id, ..., block) of the chunks that fit the context."""
        best = self.retrieve(query)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("rank_key").desc(), "doc_id")))
        block = retrieve.context_block(F.col("rank"), F.col("source"), F.col("article_no"), F.col("article_title"), F.col("text"))
        return retrieve.pack_context(ranked.withColumns({"block": block, "_all": F.lit(1)}), by=["_all"]).drop("_all", "total")

    def answer(self, query: str, history: list[dict] | None = None) -> dict:
        """A grounded answer with citations. At most ``rerank_top_k`` chunks come to the driver."""
        used = self.context(query).orderBy("rank").collect()
        text = "\n".join(r["block"] for r in used).strip()
        spark = self.chunks.sparkSession
        row = spark.createDataFrame([(query, text)], "query string, context string")
        parts = row.select(grounding.prompt(F.col("query"), F.col("context")).alias("p"), grounding.fallback_answer(F.col("context")).alias("f")).first()
        turns = [h for h in (history or [])[-config.HISTORY_ITEMS :] if h.get("role") in ("user", "assistant")]
        messages = [*({"role": h["role"], "content": str(h.get("content", ""))[: config.HISTORY_CHARS]} for h in turns), {"role": "user", "content": parts["p"]}]
        said = self.model.complete(messages) if self.model else parts["f"]
        judged = grounding.verify(spark.createDataFrame([(said, [r["text"] for r in used], len(used))], "answer string, evidence array<string>, n_chunks int"))
        final = grounding.guard(judged, self.settings.guard).first()
        cited = [{"index": r["rank"], "file_id": r["file_id"], "source": r["source"], "article_no": r["article_no"], "excerpt": r["text"][: config.CITATION_EXCERPT] + ("..." if len(r["text"]) > config.CITATION_EXCERPT else "")} for r in used]
        return {
            "answer": final["answer"], "citations": cited, "confidence": final["confidence"], "verification_score": final["score"], "refused": final["refused"],
            "retrieval_only": self.model is None, "events": answer_events([said], cited, final["answer"]),
        }

    # Tools

    def list_files(self) -> DataFrame:
        return stores.first_of_file(self.chunks).select("file_id", "source", "path")

    def status(self) -> dict:
        row = self.chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_id").alias("files")).first()
        return {"ready": row["chunks"] > 0, "chunks": row["chunks"], "files": row["files"], "vectors": self.vecs is not None}

    def get_article(self, query: str, limit: int = 5) -> DataFrame:
        from hanji.operators.chunking import article_score

        score = article_score(F.coalesce("article_no", F.lit("")), F.coalesce("article_title", F.lit("")), F.col("text"), F.lit(query))
        return self.chunks.withColumn("score", score).filter("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(limit)

    def reindex(self, chunks: DataFrame) -> Engine:
        vecs = vectors(chunks, self.embedder) if self.embedder else None
        return Engine(chunks, index.build(chunks), vecs, self.embedder, self.model, self.settings)
