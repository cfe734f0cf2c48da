"""Table functions for SQL: chunking, articles, numbering of a file's chunks, search and article lookup over an index.

``register(spark)`` makes the first three known; they are called in SQL with ``LATERAL``, or with ``TABLE (...) PARTITION BY``.
``register_search(spark, index, chunks)`` adds ``search(query)`` and ``get_article(query)`` as SQL functions over the tables of
an index. They stay ordinary plans that the optimizer sees through; the best hits come first, as many as a search may ask for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from hanji import config
from hanji.functions.text import TOKEN
from hanji.operators import index as indexes
from hanji.operators.chunking import ARTICLE_HEAD, MARKS

#: Articles that a lookup gives at most.
ARTICLES = 50


def _constant(given: AnalyzeArgument | None, default: int, name: str) -> int:
    if given is None:
        return default
    if not given.isConstantExpression or not isinstance(given.value, int):
        raise ValueError(f"{name} must be a constant number")
    return given.value


def pieces(text: str | None, size: int, overlap: int, separator: str = "\n\n") -> list[str]:
    """Paragraphs packed into chunks of up to ``size``, as :func:`hanji.operators.chunking.split` packs them."""
    overlap, size = min(overlap, size // 2), max(size, config.MIN_CHUNK)
    done, now = [], ""
    for p in filter(None, map(str.strip, (text or "").split(separator))):
        if len(now) + len(p) + 2 <= size:
            now = f"{now}\n\n{p}" if now else p
            continue
        if now:
            done.append(now)
        if len(p) > size:
            done += [s for a in range(0, len(p), max(1, size - overlap)) if (s := p[a : a + size]).strip()]
            now = ""
        else:
            now = f"{done[-1][-overlap:]}\n\n{p}" if done and overlap > 0 else p
    return done + [now] if now.strip() else done


class ChunkDocument:
    """chunk_document(text, size, overlap): (chunk_id, chunk). Sizes are constants, checked when the query is analyzed."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if _constant(size, config.CHUNK_SIZE, "size") < 1 or _constant(overlap, config.CHUNK_OVERLAP, "overlap") < 0:
            raise ValueError("size must be positive, overlap not negative")
        return AnalyzeResult(StructType().add("chunk_id", IntegerType()).add("chunk", StringType()))

    def eval(self, text: str, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> Iterator[tuple]:
        yield from enumerate(pieces(text, size, overlap))


class ParseArticles:
    """parse_articles(text): (pos, number, title, content, n_paragraphs), as :func:`hanji.operators.chunking.articles`."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType().add("pos", IntegerType()).add("number", StringType()).add("title", StringType()).add("content", StringType()).add("n_paragraphs", IntegerType()))

    def eval(self, text: str) -> Iterator[tuple]:
        heads = list(re.finditer(ARTICLE_HEAD, text or ""))
        for pos, (head, following) in enumerate(zip(heads, [*heads[1:], None], strict=True)):
            main, sub, rest = re.match(r"(?s)제\s*([0-9]+)\s*조(?:의\s*([0-9]+))?(.*)", head[0]).groups()
            body = text[head.end() : following.start() if following else len(text)]
            content = body if body.strip() else ""
            title = re.sub(r"^[()（）\[\]]+|[()（）\[\]]+$", "", rest.strip())
            yield pos, f"제{main}조" + (f"의{sub}" if sub else ""), title, content, len(re.findall(f"[{MARKS}]", content))


class NumberChunks:
    """number_chunks(TABLE(...) PARTITION BY file ORDER BY place): each row's columns, its chunk_id and the file's total.

    Blank chunks get no number and no row, but count. A partition's rows are held until its end, where the total is known.
    """

    def __init__(self):
        self.rows, self.total = [], 0

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "chunk" not in rows.dataType.fieldNames():
            raise ValueError("number_chunks takes a table with a column chunk")
        return AnalyzeResult(StructType([*rows.dataType.fields]).add("number", IntegerType()).add("total_chunks", IntegerType()))

    def eval(self, row: Row) -> None:
        self.total += 1
        if (row["chunk"] or "").strip():
            self.rows.append(tuple(row))

    def terminate(self) -> Iterator[tuple]:
        for number, row in enumerate(self.rows):
            yield (*row, number, self.total)


def register(spark: SparkSession) -> None:
    for name, kind in (("chunk_document", ChunkDocument), ("parse_articles", ParseArticles), ("number_chunks", NumberChunks)):
        spark.udtf.register(name, udtf(kind))


def register_search(spark: SparkSession, index: indexes.Index, chunks: DataFrame) -> None:
    """Functions over (doc_id, text, article_no, article_title ...): ``search`` by BM25, ``get_article`` by number, title and content."""
    index.postings.createOrReplaceTempView("hanji_postings")
    chunks.createOrReplaceTempView("hanji_chunks")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search(q STRING) RETURNS TABLE (doc_id BIGINT, score DOUBLE) RETURN
        SELECT doc_id, sum(weight) AS score FROM hanji_postings WHERE array_contains(regexp_extract_all(lower(search.q), '{TOKEN}', 0), term)
        GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {config.MAX_K}""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_article(q STRING) RETURNS TABLE (doc_id BIGINT, score INT) RETURN
        SELECT doc_id, CAST(if(contains(lower(coalesce(article_no, '')), lower(get_article.q)), 5, 0) + if(contains(lower(coalesce(article_title, '')), lower(get_article.q)), 3, 0)
          + if(contains(lower(coalesce(text, '')), lower(get_article.q)), 1, 0) AS INT) AS score FROM hanji_chunks
        WHERE contains(lower(concat_ws(' ', article_no, article_title, text)), lower(get_article.q)) ORDER BY score DESC, doc_id LIMIT {ARTICLES}""")
