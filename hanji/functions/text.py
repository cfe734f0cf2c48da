"""Text functions as Spark columns. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanji import config

# Fixed values.
TOKEN = "[0-9A-Za-z가-힣_]{2,}"
KEYWORD = "[가-힣]{2,}|[a-zA-Z]{3,}"
STOP_WORDS = ("있는", "하는", "및", "등", "이", "가", "을", "를", "의", "에", "로", "으로")
NOISE_TERMS = ("관련", "내용", "정보", "사항", "기준", "알려줘", "알려줄래", "알려주세요", "찾아줘", "검색해줘")
COMPARISON_WORDS, PROCEDURE_WORDS = ("비교", "차이", "vs", "대비"), ("절차", "방법", "어떻게", "신청")
CATEGORIES = {
    "인사": ("인사", "채용", "퇴직", "승진", "평가", "인력", "직원", "사원"),
    "회계": ("회계", "경비", "예산", "결산", "세금", "세무", "비용", "지출"),
    "보안": ("보안", "비밀", "정보보호", "접근", "암호", "인증", "개인정보"),
    "복리후생": ("복리", "후생", "건강", "보험", "연금", "지원금", "복지"),
    "근태": ("근태", "휴가", "출퇴근", "연차", "병가", "출장", "재택"),
    "윤리": ("윤리", "청렴", "공정", "부정", "비위", "행동강령"),
    "조직": ("조직", "부서", "팀", "직제", "직무", "업무분장"),
    "계약": ("계약", "협약", "협정", "입찰", "구매", "조달"),
    "기술": ("기술", "개발", "IT", "시스템", "소프트웨어", "하드웨어"),
}
OTHER = "기타"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: Column | str) -> Column:
    """Index tokens: lower-cased runs of two or more of the token characters; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


#: What ``(?U)\s`` matches.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """Without white space at the ends, Unicode white space included."""
    return F.btrim(col(text), F.lit(WHITE))


def squeeze(text: Column | str) -> Column:
    """White space runs become one blank; none at the ends."""
    return strip(F.regexp_replace(col(text), r"(?U)\s+", " "))


def compact(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", ""))


def without_noise(query: Column | str) -> Column:
    cleaned = col(query)
    for term in NOISE_TERMS:
        cleaned = F.replace(cleaned, F.lit(term), F.lit(" "))
    return squeeze(cleaned)


def without_marks(text: Column | str) -> Column:
    """Punctuation and symbols removed."""
    return F.regexp_replace(col(text), r"[\p{P}\p{S}]", "")


def intent(query: Column | str) -> Column:
    low = F.lower(col(query))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    return F.when(has(COMPARISON_WORDS), "comparison").when(has(PROCEDURE_WORDS), "procedure").otherwise("factual")


def article_number(text: Column | str) -> Column:
    """First article reference as 제N조 or 제N조의M; null without one."""
    pattern = r"제\s*([0-9]+)\s*조(?:의\s*([0-9]+))?"
    main, sub = F.regexp_extract(col(text), pattern, 1), F.regexp_extract(col(text), pattern, 2)
    return F.when(main != "", F.concat(F.lit("제"), main, F.lit("조"), F.when(sub != "", F.concat(F.lit("의"), sub)).otherwise("")))


def canonical_articles(text: Column | str) -> Column:
    """The notation rules that need neither NFKC nor arithmetic: articles, paragraphs, clauses, grades, years, annexes."""
    rules = (
        ("，", ","), (r"제\s*(\d+)\s*의\s*(\d+)\s*조", "제$1의$2조"), (r"제\s*(\d+(?:의\d+)?)\s*조", "제$1조"), (r"제\s*(\d+)\s*항", "제$1항"),
        (r"제\s*(\d+)\s*호", "제$1호"), (r"(\d+)\s*급", "$1급"), (r"(\d+)\s*년", "$1년"), (r"별지\s*제?\s*(\d+)\s*호\s*서식", "별지 제$1호 서식"),
        (r"(별표|별첨|첨부)\s*(\d+)", "$1 $2"), (r"부\s*칙", "부칙"),
    )
    out = col(text)
    for pattern, target in rules:
        out = F.regexp_replace(out, "(?U)" + pattern, target)
    return squeeze(out)


def extracted_text(text: Column | str) -> Column:
    """Extractor output made uniform: no control characters, one kind of line end, single blanks, at most one empty line."""
    value = F.coalesce(col(text), F.lit(""))
    value = F.regexp_replace(value, "\\ufeff|\\x00", "")
    value = F.regexp_replace(value, "\\r\\n?", "\n")
    value = F.regexp_replace(value, r"[\x01-\x08\x0b\x0c\x0e-\x1f]", "")
    value = F.regexp_replace(value, r"[ \t]+", " ")
    value = F.regexp_replace(value, r"(?mU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    return strip(F.regexp_replace(value, "\n{3,}", "\n\n"))


def usable(text: Column | str, least: int = 5) -> Column:
    """At least 85 % printable and some letters or digits."""
    value = extracted_text(text)
    printable = F.length(F.regexp_replace(value, r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}\p{Zl}\p{Zp}&&[^\n\t]]|[\p{Zs}&&[^ ]]", ""))
    content = F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    return (F.length(value) > 0) & (printable / F.greatest(F.length(value), F.lit(1)) >= 0.85) & (content >= least)


def half_up(value: Column, digits: int) -> Column:
    """Rounding that engines agree on: floor of the shifted value plus a half."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def quality_score(text: Column | str, warnings: Column) -> Column:
    n = F.length(extracted_text(text))
    base = F.least(F.lit(1.0), F.lit(0.25) + n / 4000.0)
    return F.when(n > 0, half_up(F.greatest(F.lit(0.0), base - F.least(F.lit(0.5), warnings * 0.05)), 3)).otherwise(0.0)


def highlight(text: Column | str, query: str, tag: str = "mark") -> Column:
    """Marks the query's words of two or more characters, longest first, whatever their case."""
    words = sorted({w for w in query.split() if len(w) >= 2}, key=lambda w: (-len(w), w))
    if not words:
        return col(text)
    quoted = "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words)
    return F.regexp_replace(col(text), f"(?iu)({quoted})", f"<{tag}>$1</{tag}>")


def truncated(text: Column | str, size: int) -> Column:
    return F.when(F.length(col(text)) > size, F.concat(F.substring(col(text), 1, size), F.lit("..."))).otherwise(col(text))


def score_percent(score: Column | str) -> Column:
    return F.floor(col(score) * 100 + 0.5).cast("int")


def score_band(score: Column | str) -> Column:
    percent = score_percent(score)
    return F.when(percent >= 70, "high").when(percent >= 40, "medium").otherwise("low")


def allowed_file(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(name), r"(\.[^./\\]+)$", 1)).isin(*config.EXTENSIONS)


def file_id(path: Column | str) -> Column:
    """First 24 hexadecimal digits of the normalized path's SHA-1."""
    return F.substring(F.sha1(col(path)), 1, 24)


SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def human_size(size: Column | str, largest: str = SIZE_UNITS[-1]) -> Column:
    """One decimal, halves to even, and a unit, from B to ``largest``."""
    out, value = None, col(size).cast("double")
    for power, unit in reversed(list(enumerate(SIZE_UNITS[: SIZE_UNITS.index(largest) + 1]))):
        text = F.concat(F.format_string("%.1f", F.bround(value / 1024.0**power, 1)), F.lit(unit))
        out = text if out is None else F.when(value < 1024.0 ** (power + 1), text).otherwise(out)
    return out


def categories(content: Column | str, name: Column | str) -> Column:
    """Categories with a keyword in the content, then those with one in the name; the catch-all without any.

    Keywords are matched as they are written against lower-cased text.
    """
    low, low_name = F.lower(F.coalesce(col(content), F.lit(""))), F.lower(F.coalesce(col(name), F.lit("")))
    has = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    first = F.array(*[F.when(has(low, words), F.lit(c)) for c, words in CATEGORIES.items()])
    second = F.array(*[F.when(~has(low, words) & has(low_name, words), F.lit(c)) for c, words in CATEGORIES.items()])
    found = F.filter(F.concat(first, second), lambda c: c.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER)))


def cache_key(query, k, hybrid, sort_by, filter_file, filter_file_id) -> Column:
    parts = [F.lower(squeeze(query)), col(k).cast("string"), col(hybrid).cast("string"), sort_by, filter_file, filter_file_id]
    return F.concat_ws("|", *[F.coalesce(col(p), F.lit("")) for p in parts])


def redacted(settings: Column | str) -> Column:
    """A map's values hidden where the key speaks of a secret."""
    return F.transform_values(col(settings), lambda k, v: F.when(F.lower(k).rlike("key|secret|token|password") & (v != ""), F.lit("***")).otherwise(v))


def age_text(then: Column | str, now: Column | str) -> Column:
    """Minutes, hours or days between two timestamps."""
    seconds = col(now).cast("long") - col(then).cast("long")
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    return (
        F.when(minutes < 1, F.lit("방금 전"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("분 전")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("시간 전")))
        .otherwise(F.concat(days.cast("string"), F.lit("일 전")))
    )


def parse_regex(raw: str, limit: int = 80) -> str | None:
    """A pattern typed as text or /text/flags, always without case; None where it is too long or invalid."""
    raw = (raw or "").strip()
    m = re.fullmatch(r"/(.+)/([a-z]*)", raw, re.S)
    body, flags = (m[1], m[2]) if m else (raw, "")
    if not body or len(body) > limit:
        return None
    inline = "".join(sorted({"i", *(f for f in flags if f in "ms")}))
    try:
        re.compile(body)
    except re.error:
        return None
    return f"(?{inline}){body}"
