"""Boolean and regular-expression search over results."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanji.functions.text import parse_regex, squeeze

MOST_PHRASES, MOST_TERMS = 8, 6


@dataclass
class BooleanQuery:
    phrases: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    clauses: list[list[str]] = field(default_factory=list)

    def literals(self) -> list[str]:
        """What to fetch candidates by: phrases first, then words of the clauses."""
        return [*self.phrases[:MOST_PHRASES], *list(dict.fromkeys(w for c in self.clauses for w in c))[:MOST_TERMS]]


def parse(query: str) -> BooleanQuery:
    """Quoted phrases are required, NOT excludes the next word or phrase, OR separates clauses, other words are joined by AND."""
    out, clause = BooleanQuery(), []
    negated = False
    for m in re.finditer(r'"([^"]*)"|(\S+)', query or ""):
        phrase, word = m[1], m[2]
        if phrase is not None:
            text = " ".join(phrase.lower().split())
            if text:
                (out.excludes if negated else out.phrases).append(text)
            negated = False
        elif word.upper() == "NOT":
            negated = True
        elif word.upper() == "OR":
            if clause:
                out.clauses.append(clause)
            clause, negated = [], False
        elif word.upper() == "AND":
            negated = False
        elif negated:
            out.excludes.append(word.lower())
            negated = False
        else:
            clause.append(word.lower())
    if clause:
        out.clauses.append(clause)
    return out


def matches(text: Column, query: BooleanQuery) -> Column:
    """Substring logic over lower-cased text with single blanks."""
    low = F.lower(squeeze(text))
    ok = F.lit(True)
    for p in query.phrases:
        ok = ok & low.contains(p)
    for e in query.excludes:
        ok = ok & ~low.contains(e)
    if query.clauses:
        some = F.lit(False)
        for clause in query.clauses:
            every = F.lit(True)
            for w in clause:
                every = every & low.contains(w)
            some = some | every
        ok = ok & some
    return ok


def boolean_filter(rows: DataFrame, query: str) -> DataFrame:
    return rows.filter(matches(F.concat_ws(" ", "text", "source"), parse(query)))


def regex_filter(rows: DataFrame, raw: str) -> DataFrame:
    """Rows whose text and source match; none where the pattern is invalid."""
    pattern = parse_regex(raw)
    if pattern is None:
        return rows.limit(0)
    return rows.filter(F.concat_ws(" ", "text", "source").rlike(pattern))


def fetch_size(k: int) -> int:
    """Candidates to fetch before filtering."""
    return min(50, max(4 * k, 20))
