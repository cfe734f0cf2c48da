"""Constants that are part of the engine's semantics."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# Fixed values.
BM25_K1, BM25_B = 1.5, 0.75
VECTOR_WEIGHT, BM25_WEIGHT = 0.7, 0.3
MIN_K, MAX_K = 1, 10
MIN_QUERY, MAX_QUERY = 2, 500
MIN_MESSAGE, MAX_MESSAGE = 2, 4000
RRF_K, RRF_FIRST, RRF_REST = 60, 1.0, 0.6
MAX_VARIANTS = 6
OVERLAP_BONUS, ARTICLE_BONUS = 0.05, 0.2
TOP_K, RERANK_TOP_K = 8, 4
CONTEXT_CHARS = 6000
MIN_CONFIDENCE = 0.35
HISTORY_ITEMS, HISTORY_CHARS = 6, 2000
RESULT_PREVIEW, CITATION_EXCERPT, TOOL_CONTENT = 1500, 300, 800
PREVIEW_DEFAULT, PREVIEW_MIN, PREVIEW_MAX = 2000, 200, 10000
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 800, 80, 100
CACHE_SIZE, CACHE_TTL, CACHE_FACTOR = 1000, 600, 2.0
SEARCH_PER_MINUTE, RAG_PER_MINUTE, ADMIN_PER_MINUTE = 300, 60, 20
CONCURRENT_SEARCHES = 10
ZIP_ENTRIES, ZIP_TOTAL, ZIP_SINGLE = 1000, 200 << 20, 50 << 20
HEALTH_TTL = 30
EXTENSIONS = (".txt", ".docx", ".pdf", ".xlsx", ".xls", ".hwp", ".hwpx")
STATUSES = ("대기", "처리중", "완료", "실패", "캐시")
REFUSAL, REFUSAL_MARK = "해당 규정에서 확인할 수 없습니다.", "확인할 수 없습니다"


@dataclass(frozen=True)
class Retrieval:
    top_k: int = TOP_K
    rerank_top_k: int = RERANK_TOP_K
    article_fast_path: bool = True
    hyde: bool = True


@dataclass(frozen=True)
class Guard:
    min_confidence: float = MIN_CONFIDENCE
    require_citation: bool = True
    disclaimer: str = ""


@dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = field(default_factory=Retrieval)
    guard: Guard = field(default_factory=Guard)


def merged(base: dict, override: dict) -> dict:
    """Nested maps merged, the override winning; neither argument changes."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def settings_from(values: dict) -> Settings:
    """Settings from stored values; unknown keys are ignored."""
    pick = lambda kind, part: kind(**{k: v for k, v in (values.get(part) or {}).items() if k in kind.__dataclass_fields__})
    return Settings(pick(Retrieval, "retrieval"), pick(Guard, "guardrails"))


@contextlib.contextmanager
def during(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what runs in here; the caller's own comes back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
