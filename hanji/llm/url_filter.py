"""URL filter by a character language-model ratio (operator 9).

Explicit host/path rules decide first, the longest fitting rule winning. Every other URL is judged by two smoothed
variable-order Markov models over characters, one trained on accepted and one on rejected URLs (the URLs that rules
decide), by the difference of their log-likelihoods per character against a threshold calibrated on rule-decided URLs
that training leaves out.

The models judge a whole URL: host, path and query (not the scheme, nor the fragment, which names no page). They are
trained on rule-decided URLs without the end of the host and the start of the path that the deciding rule spells out:
otherwise they would only relearn the rules. Fitting counts the characters of all rule-decided texts, each distinct one
once, so the driver holds distinct runs of five characters and no URLs; a quarter of the texts, by their hashes, is left
out for the threshold. Judging covers every row.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and has difference 0, which is
allowed; with no rule-decided URL of one kind there is nothing to compare and unruled URLs are allowed; a very long URL
is judged whole; repeated rows are judged alike and count once in training; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that the query applies, as (text, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Steps of a score in which left-out texts are counted for the threshold.
SCORE_STEPS = 4096
ORDER = 4
ALPHABET = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def query_of(url: Column) -> Column:
    """The query with its question mark, empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 3)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule whose host is the host or a parent of it and whose path starts the path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


@dataclass
class Markov:
    """Counts of characters after contexts of 0 to ``ORDER`` characters, mixed by Witten-Bell smoothing."""

    counts: dict[str, dict[str, int]]

    @classmethod
    def fit(cls, texts: list[str]) -> Markov:
        grams: dict[str, int] = {}
        for text in texts:
            padded = "\x02" * ORDER + text + "\x03"
            for i in range(ORDER, len(padded)):
                gram = padded[i - ORDER : i + 1]
                grams[gram] = grams.get(gram, 0) + 1
        return cls.of_grams(grams.items())

    @classmethod
    def of_grams(cls, grams) -> Markov:
        """From (characters, times) of runs of ``ORDER`` + 1 characters: shorter contexts are sums over longer ones."""
        counts: dict[str, dict[str, int]] = {}
        for gram, n in grams:
            for k in range(ORDER + 1):
                after = counts.setdefault(gram[ORDER - k : ORDER], {})
                after[gram[ORDER]] = after.get(gram[ORDER], 0) + n
        return cls(counts)

    def probability(self, context: str, char: str) -> float:
        p = 1.0 / ALPHABET
        for k in range(ORDER + 1):
            after = self.counts.get(context[ORDER - k :])
            if after is None:
                break
            total, kinds = sum(after.values()), len(after)
            p = (after.get(char, 0) + kinds * p) / (total + kinds)
        return p


@dataclass
class Ratio:
    """Log-likelihood of accepted over rejected, per character; ``threshold`` is where the verdict turns."""

    allow: Markov
    block: Markov
    threshold: float = 0.0

    def score(self, text: str, memo: dict[str, float]) -> float:
        if not text:
            return 0.0
        padded, total = "\x02" * ORDER + text + "\x03", 0.0
        for i in range(ORDER, len(padded)):
            gram = padded[i - ORDER : i + 1]
            part = memo.get(gram)
            if part is None:
                if len(memo) >= 200_000:
                    memo.clear()
                part = memo[gram] = math.log(self.allow.probability(gram[:-1], gram[-1]) / self.block.probability(gram[:-1], gram[-1]))
            total += part
        return total / (len(padded) - ORDER)


def best_cut(good: list[tuple[float, int]], bad: list[tuple[float, int]]) -> float:
    """The cut with the best balanced accuracy on (score, times) of both kinds; the one nearest to 0 among equals."""

    def below(rows: list[tuple[float, int]]):
        rows = sorted(rows)
        scores, sums = [r[0] for r in rows], [0, *itertools.accumulate(r[1] for r in rows)]
        return lambda c: sums[bisect.bisect_left(scores, c)] / sums[-1]

    cuts = sorted({score for score, _ in (*good, *bad)})
    options = [0.0, *((a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False))]
    good_below, bad_below = below(good), below(bad)
    return max(options, key=lambda c: (round(1 - good_below(c) + bad_below(c), 9), -abs(c)))


def calibrated(allow: list[str], block: list[str]) -> Ratio | None:
    """Fit on three quarters of each kind; the threshold gives the best balanced accuracy on the last quarter."""
    part = lambda texts, held: [t for i, t in enumerate(texts) if (i % 4 == 3) == held]
    if not part(allow, False) or not part(block, False):
        return None
    ratio, memo = Ratio(Markov.fit(part(allow, False)), Markov.fit(part(block, False))), {}
    good, bad = ([(ratio.score(t, memo), 1) for t in part(texts, True)] for texts in (allow, block))
    if good and bad:
        ratio.threshold = best_cut(good, bad)
    return ratio


def gram_counts(texts: DataFrame) -> DataFrame:
    """(verdict, gram, times): runs of ``ORDER`` + 1 characters in the texts, with the marks of start and end."""
    padded = F.concat(F.lit("\x02" * ORDER), F.col("_seen"), F.lit("\x03"))
    runs = F.transform(F.sequence(F.lit(1), F.length("_seen") + 1), lambda i: F.substring(F.col("_padded"), i, F.lit(ORDER + 1)))
    return texts.withColumn("_padded", padded).select("verdict", F.explode(runs).alias("gram")).groupBy("verdict", "gram").agg(F.count("*").alias("times"))


def scorer(ratio: Ratio | None):
    """Scores less the threshold of a column of texts; 0 for empty texts and without models."""

    @F.pandas_udf("double")
    def score(seen: pd.Series) -> pd.Series:
        memo: dict[str, float] = {}
        if ratio is None:
            return pd.Series(0.0, index=seen.index)
        return seen.map(lambda t: ratio.score(t, memo) - (ratio.threshold if t else 0.0)).astype("float64")

    return score


def fit(ruled: DataFrame) -> Ratio | None:
    """Models and threshold from all rows of (verdict, _seen); equal rows count once, so none is on both sides of the split."""
    texts = ruled.filter("verdict IN ('allow', 'block')").select("verdict", "_seen").distinct().withColumn("_held", F.pmod(F.xxhash64("_seen"), F.lit(4)) == 3)
    grams: dict[str, list] = {"allow": [], "block": []}
    for verdict, gram, n in gram_counts(texts.filter("NOT _held")).toLocalIterator():
        grams[verdict].append((gram, n))
    if not grams["allow"] or not grams["block"]:
        return None
    ratio = Ratio(Markov.of_grams(grams["allow"]), Markov.of_grams(grams["block"]))
    step = F.floor(scorer(ratio)("_seen") * SCORE_STEPS)
    held: dict[str, list] = {"allow": [], "block": []}
    for verdict, at, n in texts.filter("_held").select("verdict", step.alias("at")).groupBy("verdict", "at").count().collect():
        held[verdict].append(((at + 0.5) / SCORE_STEPS, n))
    if held["allow"] and held["block"]:
        ratio.threshold = best_cut(held["allow"], held["block"])
    return ratio


def seen_text(host: Column, path: Column, query: Column, rule: Column) -> Column:
    """What the models read: host, path and query, without the host's end and the path's start that ``rule`` (or null) spells out."""
    rule_host, rule_path = F.substring_index(rule, "/", 1), F.substring(rule, F.instr(rule, "/"), F.length(rule))
    own = F.regexp_replace(F.substring(host, F.lit(1), F.length(host) - F.length(rule_host)), r"\.$", "")
    rest = F.concat(own, F.lit("/"), F.substring(path, F.length(rule_path) + 1, F.length(path)), query)
    return F.when(rule.isNull(), F.concat(host, path, query)).otherwise(rest)


def filter_urls(pages: DataFrame, *, url="url", keep=("page_id",), rules=RULES) -> DataFrame:
    """``keep``, url, host, path, rule, verdict and score (the difference above the threshold; null where a rule decides)."""
    found = pages.select(*keep, F.col(url).cast("string").alias("url"))
    found = found.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    found = found.withColumn("_seen", seen_text(F.col("host"), F.col("path"), query_of(F.col("url")), F.col("_r.rule")))
    score = scorer(fit(found.filter("_r IS NOT NULL").select(F.col("_r.verdict").alias("verdict"), "_seen")))
    scored = found.withColumn("score", F.when(F.col("_r").isNull(), score("_seen")))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("score") >= 0, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select(*keep, "url", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "score")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
