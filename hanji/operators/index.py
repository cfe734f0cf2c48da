"""The inverted index as ordinary tables, and BM25 over it.

``postings`` (term, doc_id, tf, dl, weight), ``doc_stats`` (doc_id, dl), ``term_stats`` (term, df, idf) and the one-row
``corpus_stats`` (n, avgdl). Statistics are known when an index is built, so a posting carries its whole part of a score,
and a query is one scan and one sum. It touches only the postings of its terms: they are pushed down to the scan as a
list of literals, stored tables are pruned by the term's bucket, and cached ones by the ranges of terms they lie in.
An index that is built to be stored shuffles its postings once: tasks count the terms of their documents, a bucket's part
gets all postings of its terms, in their order, and so knows how many documents have each.
:mod:`hanji.operators.segments` is the index for collections that change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanji import config
from hanji.functions.text import tokenize

#: Folders of stored postings, by term; parts of each that are sorted by a task of their own. Up to 200 parts in all, a
#: shuffle writes each as it comes; of more it sorts them first, which spills.
BUCKETS, PARTS = 64, 3
#: Bytes of tokens that a task gets at once: they are held several times over, in the JVM and in the worker.
BATCH_BYTES = 4 << 20


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dl, tokens) to (term, doc_id, tf, dl), each document's distinct terms."""
    for batch in batches:
        lists = batch.column("tokens")
        tokens = lists.flatten()
        if not len(tokens):
            continue
        coded = tokens.dictionary_encode()
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        # By term, so that what is alike lies together in the shuffle.
        pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lists) + owner, return_counts=True)
        row = pa.array(pair % len(lists))
        yield pa.record_batch({"term": coded.dictionary.take(pa.array(pair // len(lists))), "doc_id": batch.column("doc_id").take(row), "tf": pa.array(tf.astype(np.int64)), "dl": batch.column("dl").take(row)})


@dataclass
class Index:
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    #: What it was built of, which an index that is read has not.
    docs: DataFrame | None = None

    def save(self, path: str) -> None:
        """Write all tables; postings by term bucket and sorted by term, so that a query reads few row groups."""
        if self.docs is not None:
            return self._save(path)
        bucketed = self.postings.withColumn("bucket", _bucket("term"))
        bucketed.repartition("bucket").sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        for name in ("doc_stats", "term_stats", "corpus_stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def _save(self, path: str) -> None:
        """The same tables from the documents: their lengths first, from which the collection's numbers follow, then the postings, then the terms."""
        spark = self.docs.sparkSession

        def write(rows: DataFrame, name: str, *by: str) -> DataFrame:
            rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}", compression="zstd")
            return spark.read.parquet(f"{path}/{name}")

        lengths = write(document_lengths(self.docs), "doc_stats")
        corpus = write(corpus_statistics(lengths), "corpus_stats")
        with config.during(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
            postings = write(bucketed(self.docs, lengths, corpus), "postings", "bucket")
        write(term_statistics(postings, corpus), "term_stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "doc_stats", "term_stats", "corpus_stats")])

    def persist(self) -> Index:
        """Cache all tables; postings in ranges of terms, so that a search skips most of their batches."""
        ranged = self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id")
        return Index(*[t.persist() for t in (ranged, self.doc_stats, self.term_stats, self.corpus_stats)])


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf)."""
    exploded = docs.select("doc_id", F.explode(tokenize("text")).alias("term"))
    return exploded.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(tokenize("text")).cast("long").alias("dl"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """(n, avgdl); documents without tokens count."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"))


def idf(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def term_statistics(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(corpus)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def build(docs: DataFrame) -> Index:
    lengths = document_lengths(docs)
    corpus = corpus_statistics(lengths)
    tokens = docs.select("doc_id", tokenize("text").alias("tokens"))
    exploded = tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    counted = exploded.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))
    terms = term_statistics(counted, corpus)
    part = weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf")).alias("weight")
    postings = counted.join(terms.select("term", "idf"), "term").crossJoin(F.broadcast(corpus.select("avgdl"))).select("term", "doc_id", "tf", "dl", part)
    return Index(postings, lengths, terms, corpus, docs)


def bucketed(docs: DataFrame, lengths: DataFrame, corpus: DataFrame) -> DataFrame:
    """Postings with their bucket, in whole terms by task and in order: one shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", F.explode(F.array(tokenize("text"))).alias("tokens")).select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens")
    counted = tokens.mapInArrow(_tallied, f"term string, doc_id {kind}, tf long, dl long").withColumns({"bucket": _bucket("term"), "part": F.pmod(F.hash("term"), F.lit(PARTS))})
    dealt = counted.repartition(BUCKETS * PARTS, "bucket", "part")
    if not lengths.groupBy("doc_id", "dl").count().filter("count > 1").isEmpty():
        # Rows of one id and length are one document, whose counts are summed.
        dealt = dealt.groupBy("bucket", "part", "term", "doc_id", "dl").agg(F.sum("tf").alias("tf"))
    df = F.count("*").over(Window.partitionBy("bucket", "part", "term"))
    ordered = dealt.sortWithinPartitions("bucket", "part", "term", "doc_id").withColumn("df", df).crossJoin(F.broadcast(corpus))
    return ordered.select("term", "doc_id", "tf", "dl", weight(F.col("tf"), F.col("dl"), F.col("avgdl"), idf(F.col("n"), F.col("df"))).alias("weight"), "bucket")


def weight(tf, dl, avgdl, idf_, k1=config.BM25_K1, b=config.BM25_B):
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def search(index: Index, terms: list[str]) -> DataFrame:
    """(doc_id, score) of all documents with a query term; each distinct term counts once, unknown terms not at all."""
    wanted = sorted({t.lower() for t in terms})
    if not wanted:
        return index.doc_stats.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    found = index.postings.filter(F.col("term").isin(wanted))
    if "bucket" in index.postings.columns:
        # Folded to literals, so that partitions are pruned before the scan.
        found = found.filter(F.col("bucket").isin([_bucket(F.lit(t)) for t in wanted]))
    return found.groupBy("doc_id").agg(F.sum("weight").alias("score"))


def _is(term: str):
    return lambda x: x == term


def scan(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The same scores without an index: documents' tokens are filtered in place, so only matches leave the scan.

    Two passes over the texts, no shuffle: one for the statistics, which come back as one row, one for the scores.
    """
    wanted = sorted({t.lower() for t in terms})

    def counts(tokens):
        return F.struct(F.size(tokens).alias("dl"), *[F.size(F.filter(tokens, _is(t))).alias(f"tf{i}") for i, t in enumerate(wanted)])

    # A generator of one row, below which the filter on counts is not pushed: each text is tokenized once a pass.
    counted = docs.select("doc_id", F.inline(F.transform(F.array(tokenize("text")), counts)))
    stats = counted.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]
    )
    joined = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(wanted))) or "false").crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        part = weight(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"), idf(F.col("n"), F.col(f"df{i}")))
        score = score + F.when(F.col(f"tf{i}") > 0, part).otherwise(0.0)
    return joined.select("doc_id", score.alias("score"))


def top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best, ties by doc_id: each partition keeps its k, and those meet."""
    return scores.orderBy(F.col(score).desc(), F.col("doc_id").asc()).limit(k)
