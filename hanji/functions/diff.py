"""Comparison of two versions of a text, and corpus keywords."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from hanji.functions.text import KEYWORD, STOP_WORDS


COMPARED = StructType().add("added", IntegerType()).add("removed", IntegerType()).add("total", IntegerType()).add("diff_text", StringType()).add("similarity", DoubleType())


def compared(a: str | None, b: str | None) -> dict:
    """Lines added and removed, the unified diff and the similarity of characters."""
    one, two = (a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True)
    lines = list(difflib.unified_diff(one, two, lineterm=""))
    added = sum(x[:1] == "+" and x[:3] != "+++" for x in lines)
    removed = sum(x[:1] == "-" and x[:3] != "---" for x in lines)
    same = difflib.SequenceMatcher(None, a or "", b or "").ratio()
    return {"added": added, "removed": removed, "total": added + removed, "diff_text": "".join(lines), "similarity": same}


@F.pandas_udf(COMPARED)
def diff_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compared(x, y) for x, y in zip(a, b, strict=True)], columns=["added", "removed", "total", "diff_text", "similarity"])


def inline_changes(a: str, b: str) -> tuple[str, str]:
    """Both texts with what differs marked: removed in the first, inserted in the second."""
    left, right = [], []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
        same = kind == "equal"
        if j > i:
            left.append(a[i:j] if same else f"<del>{a[i:j]}</del>")
        if m > k:
            right.append(b[k:m] if same else f"<ins>{b[k:m]}</ins>")
    return "".join(left), "".join(right)


def keywords(docs: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent words that are no stop words, out of the 2k most frequent; ties by word."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(KEYWORD), F.lit(0))).alias("keyword"))
    many = words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "keyword").limit(2 * k)
    return many.filter(~F.col("keyword").isin(*STOP_WORDS)).orderBy(F.col("n").desc(), "keyword").limit(k)
