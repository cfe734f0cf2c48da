"""A training corpus from ``documents`` in five stages: language, quality, near-duplicates, mixing, packing.

Each stage is written to the shared folder and read again as the next one's input, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanji.llm import lang_id, minhash_dedup, mixing, packing, quality_rules
from hanji.llm.common import settle


#: A document stays if one language covers at least this share of its letters: below, no language holds even half of it.
LEAST_SHARE = 0.5
#: Languages that the corpus wants, as the labels of ``lang`` name them; None wants every language that is learned.
LANGUAGES: tuple[str, ...] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are, by their labelled spans, mostly in one wanted language.

    Null, empty and letterless texts are in none and go; so do texts whose spans are of several languages without a
    majority. Very long texts are labelled whole; repeated rows are judged alike; a null ``lang`` or ``doc_id`` does not
    matter; without any learnable row nothing is in a language and all go; extra columns, whatever their names, stay.
    """
    named = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    found = lang_id.detect(named, lang_id.fit(docs, F.lit(True)), keep=["row"], keep_text=True)
    wanted = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)
    if LANGUAGES is not None:
        wanted &= F.col("lang_pred").isin(*LANGUAGES)
    return found.filter(wanted).select(*[F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that neither the base rule nor the cascade rejects.

    Null and empty texts have no words and go; very long texts are judged whole; repeated rows and null ids are judged
    like others; an empty table stays empty; extra columns, whatever their names, stay.
    """
    named = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return quality_rules.judge(named, keep=["row"]).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest id.

    A row without id is named after its text, by a number above all others, so that it gives way to rows with ids and
    to its own copies. Rows that share an id are one document to the search; of them the first in the order of their
    columns stays, so that repeated rows leave one. Texts without words are in no group. An empty table stays empty.
    """
    none = F.lit((1 << 63) - 1).cast("long") - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 60))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("_id"), F.struct(*docs.columns).alias("row"))
    found = minhash_dedup.near_duplicates(named.select(F.col("_id").alias("doc_id"), "row.text"))
    counts = settle(found.groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("rows")).filter("rows > 1 OR NOT kept"))
    left = named.join(counts.select(F.col("doc_id").alias("_id"), "kept", "rows"), "_id", "left").filter("kept IS NULL OR kept")
    first = left.filter("rows > 1").groupBy("_id").agg(F.min("row").alias("row"))
    return left.filter("rows IS NULL").select("row").unionByName(first.select("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come near their targets. Copies keep their id.

    A null source is a source of its own; texts without words count nothing; rows that share an id are drawn alike; an
    empty table stays empty; extra columns, whatever their names, stay.
    """
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents, copies included, in sequences.

    A null text is empty and packs as the separator alone; very long texts are cut; rows that share an id, or have none,
    are dealt singly; an empty table gives no sequence; extra columns are ignored.
    """
    packed, _ = packing.pack(settle(packing.pieces(docs.select("doc_id", "text"))))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language),
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Tokenization and language models are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
