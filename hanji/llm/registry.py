"""The registered queries of this package and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hanji.llm.audio_fingerprint import op1_audio_fingerprint
from hanji.llm.centroid_cluster import OP11_SQL, op11_centroid_cluster
from hanji.llm.chat_format import OP2_SQL, op2_chat_format
from hanji.llm.collocations import OP12_SQL, op12_collocations
from hanji.llm.html_extract import op10_html_extract
from hanji.llm.lang_id import op3_language_id
from hanji.llm.minhash_dedup import OP6_SQL, op6_minhash_dedup
from hanji.llm.mixing import OP4_SQL, op4_mix_sources
from hanji.llm.packing import op8_best_fit_packing
from hanji.llm.quality_rules import OP5_SQL, op5_quality_cascade
from hanji.llm.toxicity import op7_toxicity
from hanji.llm.url_filter import op9_url_filter
from hanji.llm.warc import OP13_SQL, op13_warc_salvage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio_fingerprint": op1_audio_fingerprint,
    "op2_chat_format": op2_chat_format,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_cascade": op5_quality_cascade,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_url_filter": op9_url_filter,
    "op10_html_extract": op10_html_extract,
    "op11_centroid_cluster": op11_centroid_cluster,
    "op12_collocations": op12_collocations,
    "op13_warc_salvage": op13_warc_salvage,
}
ORACLES: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op4_mix_sources": OP4_SQL,
    "op5_quality_cascade": OP5_SQL,
    "op6_minhash_dedup": OP6_SQL,
    "op11_centroid_cluster": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_warc_salvage": OP13_SQL,
}
