"""Article-aware chunking as array functions: one row per document in, one row per chunk out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanji import config
from hanji.functions.text import strip

ARTICLE_HEAD = r"제\s*[0-9]+\s*조(?:의\s*[0-9]+)?[^\n]*"
CHAPTER_HEAD = r"제\s*[0-9]+\s*장[^\n]*"
ANNEX_HEAD = r"(?m)^(?:부칙|별표\s*[0-9]+|별첨\s*[0-9]+|첨부\s*[0-9]+)"
MARKS = "①②③④⑤⑥⑦⑧⑨⑩"
CHUNK = "struct<text:string,article_no:string,article_title:string,chunk_type:string,sub_chunk_id:int>"


def _chunk(text, no, title, kind, sub=None) -> Column:
    return F.struct(
        text.alias("text"), no.alias("article_no"), title.alias("article_title"), kind.alias("chunk_type"), (F.lit(None) if sub is None else sub).cast("int").alias("sub_chunk_id")
    ).cast(CHUNK)


def _none() -> Column:
    return F.array().cast(f"array<{CHUNK}>")


def split(text: Column, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP, separator: str = "\n\n") -> Column:
    """Paragraphs packed into chunks of up to ``size``; longer paragraphs are sliced; a chunk starts with the last one's tail.

    A fold over the paragraphs with the chunk under construction and those finished.
    """
    overlap = min(overlap, size // 2)
    size = max(size, config.MIN_CHUNK)
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), strip), lambda p: p != "")
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))
    step = max(1, size - overlap)

    def take(acc: Column, p: Column) -> Column:
        cur, done = acc["cur"], acc["done"]
        joined = F.when(cur != "", F.concat(cur, F.lit("\n\n"), p)).otherwise(p)
        flushed = F.when(cur != "", F.concat(done, F.array(cur))).otherwise(done)
        starts = F.sequence(F.lit(0), F.length(p) - 1, F.lit(step))
        slices = F.filter(F.transform(starts, lambda i: F.substring(p, i + 1, F.lit(size))), lambda s: strip(s) != "")
        last = F.element_at(flushed, -1)
        tail = F.when(F.length(last) > overlap, F.substring(last, F.length(last) - overlap + 1, F.lit(overlap))).otherwise(last)
        carried = F.when((F.size(flushed) > 0) & F.lit(overlap > 0), F.concat(tail, F.lit("\n\n"), p)).otherwise(p)
        return (
            F.when(F.length(cur) + F.length(p) + 2 <= size, state(done, joined))
            .when(F.length(p) > size, state(F.concat(flushed, slices), F.lit("")))
            .otherwise(state(flushed, carried))
        )

    zero = state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(parts, zero, take, lambda acc: F.when(strip(acc["cur"]) != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def _heads_and_bodies(text: Column, pattern: str) -> Column:
    """array<struct<head, body>>: each heading with what follows it up to the next; what precedes the first is dropped."""
    heads = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.split(text, pattern, -1)
    return F.transform(heads, lambda h, i: F.struct(h.alias("head"), F.coalesce(F.get(bodies, i + 1), F.lit("")).alias("body")))


def articles(text: Column) -> Column:
    """array<struct<number, title, content, paragraphs>> of the articles in a text, wherever in a line they start."""

    def made(x: Column) -> Column:
        pattern = r"(?s)제\s*([0-9]+)\s*조(?:의\s*([0-9]+))?(.*)"
        main, sub, rest = (F.regexp_extract(x["head"], pattern, g) for g in (1, 2, 3))
        number = F.concat(F.lit("제"), main, F.lit("조"), F.when(sub != "", F.concat(F.lit("의"), sub)).otherwise(""))
        title = F.regexp_replace(strip(rest), r"^[()（）\[\]]+|[()（）\[\]]+$", "")
        content = F.when(strip(x["body"]) != "", x["body"]).otherwise("")
        marked = F.regexp_extract_all(content, F.lit(f"([{MARKS}])([^{MARKS}]*)"), F.lit(0))
        paragraphs = F.transform(marked, lambda m: F.struct(F.substring(m, 1, 1).alias("marker"), strip(F.substring(m, F.lit(2), F.length(m))).alias("content")))
        return F.struct(number.alias("number"), title.alias("title"), content.alias("content"), paragraphs.alias("paragraphs"))

    return F.transform(_heads_and_bodies(F.coalesce(text, F.lit("")), ARTICLE_HEAD), made)


def find_article(text: Column, query: Column) -> Column:
    """The first article whose number holds the first digits of the query."""
    digits = F.regexp_extract(query, "[0-9]+", 0)
    return F.when(digits != "", F.get(F.filter(articles(text), lambda a: a["number"].contains(digits)), F.lit(0)))


def article_score(number: Column, title: Column, content: Column, query: Column) -> Column:
    low = F.lower(query)
    hit = lambda c, points: F.when(F.lower(c).contains(low), points).otherwise(0)
    return hit(number, 5) + hit(title, 3) + hit(content, 1)


def sections(text: Column, source: Column, kind: str = "article") -> Column:
    """array<struct<title, content, type, source>> by article or chapter headings."""
    pattern = CHAPTER_HEAD if kind == "chapter" else ARTICLE_HEAD
    return F.transform(
        _heads_and_bodies(F.coalesce(text, F.lit("")), pattern),
        lambda x: F.struct(strip(x["head"]).alias("title"), strip(x["body"]).alias("content"), F.lit(kind).alias("type"), source.alias("source")),
    )


def split_by_size(text: Column, most: int = 5000) -> Column:
    """array<struct<title, content, type>>: paragraphs packed up to ``most``; one that is longer by itself is cut there."""
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))

    def take(acc: Column, p: Column) -> Column:
        over = F.length(acc["cur"]) + F.length(p) > most
        return (
            F.when(~over, state(acc["done"], F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit("\n\n"), p)).otherwise(p)))
            .when(acc["cur"] != "", state(F.concat(acc["done"], F.array(strip(acc["cur"]))), p))
            .otherwise(state(F.concat(acc["done"], F.array(F.substring(p, 1, most))), F.lit("")))
        )

    zero = state(F.array().cast("array<string>"), F.lit(""))
    parts = F.aggregate(
        F.split(F.coalesce(text, F.lit("")), "\n\n"), zero, take, lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"])
    )
    return F.transform(parts, lambda c, i: F.struct(F.concat(F.lit("파트 "), (i + 1).cast("string")).alias("title"), c.alias("content"), F.lit("size_split").alias("type")))


def table_chunks(text: Column, size: int = config.CHUNK_SIZE) -> Column:
    """Runs of lines in pipes, of at least twenty characters; the text's last line needs no line end."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:\|[^\n]+\|(?:\n|\z))+"), F.lit(0))
    long_ones = F.filter(F.transform(runs, strip), lambda t: F.length(t) >= 20)
    cut = lambda t: F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, size), F.lit("...")))
    return F.transform(long_ones, lambda t: _chunk(cut(t), F.lit(""), F.lit("표"), F.lit("table")))


def _sized(section: Column, no: Column, title: Column, short: Column, long: Column, size: int, overlap: int) -> Column:
    whole = F.array(_chunk(section, no, title, short))
    return F.when(section == "", _none()).when(F.length(section) <= size, whole).otherwise(F.transform(split(section, size, overlap), lambda s, i: _chunk(s, no, title, long, i)))


def annex_chunks(text: Column, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> Column:
    def made(x: Column) -> Column:
        head = strip(x["head"])
        kind = F.when(head.startswith("부칙"), F.lit("supplementary")).otherwise(F.lit("annex"))
        return _sized(strip(F.concat(head, F.lit("\n"), strip(x["body"]))), F.lit(""), head, kind, kind, size, overlap)

    return F.flatten(F.transform(_heads_and_bodies(F.coalesce(text, F.lit("")), ANNEX_HEAD), made))


def article_chunks(text: Column, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> Column:
    def made(a: Column) -> Column:
        section = strip(F.concat(a["number"], F.lit(" "), strip(a["title"]), F.lit("\n"), strip(a["content"])))
        return _sized(section, a["number"], strip(a["title"]), F.lit("article"), F.lit("paragraph"), size, overlap)

    return F.flatten(F.transform(articles(text), made))


def structured_chunks(text: Column, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> Column:
    """Tables, annexes and articles; plain splitting only where there are none of them."""
    found = F.concat(table_chunks(text, size), annex_chunks(text, size, overlap), article_chunks(text, size, overlap))
    plain = F.transform(split(text, size, overlap), lambda c: _chunk(c, F.lit(""), F.lit(""), F.lit("generic")))
    return F.when(F.size(found) > 0, found).otherwise(plain)


def chunk_table(files: DataFrame, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk of ``files`` (file_id, source, path, text): ordinal in the file, number of chunks, structure.

    Blank chunks get no row and no ordinal, but count among the file's chunks.
    """
    from hanji.functions.text import extracted_text

    made = files.withColumn("_chunks", structured_chunks(extracted_text("text"), size, overlap))
    total = F.size("_chunks")
    kept = F.filter("_chunks", lambda c: strip(c["text"]) != "")
    return made.select("file_id", "source", "path", total.alias("total_chunks"), F.posexplode(kept).alias("chunk_id", "c")).select("file_id", "source", "path", "chunk_id", "total_chunks", "c.*")


def numbered(rows: DataFrame, order: list[str], name: str = "doc_id", parts: int = 64) -> DataFrame:
    """Dense numbers from 0 in the given order without one task for all rows.

    Rows are dealt by ranges and counted a range; each range starts after the sum of those before (one short row each).
    """
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + place - 1).drop("_part", "_n", "_before")
