"""Grounding: claims of an answer against evidence, confidence, guardrails, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanji import config
from hanji.functions.text import compact, half_up, strip

LEAST_CLAIM, MOST_UNSUPPORTED, UNSUPPORTED_CHARS = 12, 5, 120


def claims(answer: Column) -> Column:
    """Bulleted lines, and sentences of more than twelve characters of other lines; the whole answer if there are none."""
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    cut = r"(?U)(?<=[.!?。])\s+|[.。]\s*"
    long_ones = lambda line: F.filter(F.transform(F.split(line, cut), strip), lambda s: F.length(s) > LEAST_CLAIM)
    of_line = lambda x: (
        F.when(x.startswith("- "), F.array(strip(F.substring(x, F.lit(3), F.length(x)))))
        .when(x.startswith("|") | x.startswith("#"), F.array().cast("array<string>"))
        .otherwise(long_ones(x))
    )
    found = F.flatten(F.transform(lines, of_line))
    whole = strip(F.coalesce(answer, F.lit("")))
    return F.when(F.size(found) > 0, found).when(F.length(whole) > LEAST_CLAIM, F.array(whole)).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), F.lower), lambda w: w != "")


def evidence_tokens(texts: Column) -> Column:
    """Distinct lower-cased words of all texts, and each text as a whole without white space."""
    wholes = F.filter(F.transform(texts, compact), lambda c: c != "")
    return F.array_distinct(F.concat(F.flatten(F.transform(texts, words)), wholes))


def support(n: Column, overlap: Column) -> Column:
    """struct<status, score> of a claim with ``n`` words, of which ``overlap`` occur in the evidence."""
    ratio = overlap / F.greatest(n, F.lit(1))
    needed = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(n / 2)))
    made = lambda status, score: F.struct(F.lit(status).alias("status"), score.cast("double").alias("score"))
    return (
        F.when(n == 0, made("not_checkable", F.lit(1.0)))
        .when(overlap >= needed, made("supported", F.least(F.lit(1.0), F.greatest(F.lit(0.35), ratio))))
        .when(overlap > 0, made("partial", F.greatest(F.lit(0.1), ratio)))
        .otherwise(made("unsupported", F.lit(0.0)))
    )


def claim_support(claim: Column, tokens: Column) -> Column:
    """:func:`support` of a claim against a set of evidence tokens in its row."""
    own = F.filter(words(claim), lambda w: F.length(w) > 1)
    return support(F.size(own), F.size(F.filter(own, lambda w: F.array_contains(tokens, w))))


def support_by_join(claims_: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, s): the same for claims (key, claim) against distinct evidence words (w) of any number."""
    own = claims_.select(key, F.explode_outer(F.filter(words(F.col("claim")), lambda w: F.length(w) > 1)).alias("w"))
    counted = own.groupBy(key, "w").agg(F.count("w").alias("n")).join(evidence.select("w", F.lit(True).alias("found")), "w", "left")
    totals = counted.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("found"), F.col("n")).otherwise(0)).alias("overlap"))
    return totals.select(key, support(F.col("n"), F.col("overlap")).alias("s"))


def verify(rows: DataFrame, answer: str = "answer", evidence: str = "evidence") -> DataFrame:
    """Adds score, supported, total and unsupported. ``evidence`` is an array of texts. Every row stays in its place."""
    counted = rows.withColumn("_tokens", evidence_tokens(F.col(evidence))).withColumn("_claims", claims(F.col(answer)))
    judged = counted.withColumn("_s", F.transform("_claims", lambda c: claim_support(c, F.col("_tokens"))))
    total = F.size("_s")
    supported = F.size(F.filter("_s", lambda s: s["status"] != "unsupported"))
    average = F.aggregate("_s", F.lit(0.0), lambda a, s: a + s["score"]) / total
    none = F.size(F.coalesce(F.col(evidence), F.array().cast("array<string>"))) == 0
    score = F.when(none, 0.0).when(total == 0, 0.3).otherwise(half_up(F.least(F.lit(1.0), average * 0.6 + supported / total * 0.4), 3))
    lost = F.filter(F.zip_with("_claims", "_s", lambda c, s: F.when(s["status"] == "unsupported", F.substring(c, 1, UNSUPPORTED_CHARS))), lambda c: c.isNotNull())
    return judged.select(
        *rows.columns, score.alias("score"), F.when(none, 0).otherwise(supported).alias("supported"), F.when(none, 0).otherwise(total).alias("total"),
        F.slice(lost, 1, MOST_UNSUPPORTED).alias("unsupported"),
    )


def confidence(answer: Column, n_chunks: Column, verification: Column, *, require_citation: bool = True) -> Column:
    cited = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda c: c.cast("int")))
    valid = F.size(F.filter(cited, lambda c: (c >= 1) & (c <= n_chunks)))
    bonus = F.least(F.lit(0.2), valid * 0.05)
    if require_citation:
        bonus = F.when(F.size(cited) == 0, 0.15).otherwise(bonus)
    blended = verification * 0.75 + bonus + F.least(F.lit(0.1), n_chunks * 0.02)
    return F.when(n_chunks == 0, 0.0).when(answer.contains(config.REFUSAL_MARK), 0.1).otherwise(F.least(F.lit(1.0), half_up(blended, 3)))


def guard(rows: DataFrame, settings: config.Guard = config.Guard()) -> DataFrame:  # noqa: B008
    """``rows``: answer, n_chunks, score. Adds confidence and refused; the answer is replaced and closed where needed."""
    conf = confidence(F.col("answer"), F.col("n_chunks"), F.col("score"), require_citation=settings.require_citation)
    judged = rows.withColumn("confidence", conf)
    weak = (F.col("confidence") < settings.min_confidence) & F.lit(settings.require_citation)
    refused = (F.col("n_chunks") == 0) | weak
    answer = F.when((F.col("n_chunks") == 0) | (weak & ~F.col("answer").contains(config.REFUSAL_MARK)), F.lit(config.REFUSAL)).otherwise(F.col("answer"))
    judged = judged.withColumns({"refused": refused, "answer": answer})
    if settings.disclaimer:
        closed = F.concat(F.rtrim("answer"), F.lit(f"\n\n— {settings.disclaimer}"))
        judged = judged.withColumn("answer", F.when(F.col("answer").contains(settings.disclaimer), F.col("answer")).otherwise(closed))
    return judged.withColumn("answer", strip("answer"))


def fallback_answer(context: Column) -> Column:
    """What is answered without a language model."""
    none = F.lit(f"{config.REFUSAL} (LLM을 사용할 수 없어 검색 결과만 제공합니다.)")
    some = F.concat(F.lit("LLM을 사용할 수 없어 검색된 규정 발췌 내용을 안내합니다.\n\n"), F.substring(context, 1, 2000))
    return F.when(strip(F.coalesce(context, F.lit(""))) == "", none).otherwise(some)


def prompt(query: Column, context: Column) -> Column:
    return F.concat(
        F.lit("다음은 사내 규정 발췌 내용입니다.\n\n"), context, F.lit("\n\n질문: "), F.substring(F.coalesce(query, F.lit("")), 1, config.MAX_MESSAGE),
        F.lit("\n\n위 컨텍스트만 근거로 답변하고, 각 주장 뒤에 [번호] 인용을 붙이세요."),
    )
