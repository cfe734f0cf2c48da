"""HTML extraction with a suffix array over each host's pages (operator 10).

A page becomes a list of blocks (runs of text between block-level tags). Blocks inside elements that are furniture by
their tag or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments and the like) go, and
if the page marks its article (``article`` or ``main``), what stands outside it. The suffix array of the host then judges
the tokens that are left of every page: those in token runs that repeat across distinct pages of the host go, unique runs
stay, also within a block.

Taken literally, that would remove passages that several articles of a host share, and articles that are varied copies of
each other, which belong to the result. So what a page itself marks as its article goes only if the run stands on at least
:data:`MARKED_SHARE` of the host's distinct pages (and on :data:`MARKED_PAGES`); on pages without a mark :data:`RUN_PAGES`
distinct pages suffice, whatever the size of the host. Pages with the same tokens are one distinct page.

The array takes every suffix of every page. Suffixes are told by a hash of their first :data:`RUN_TOKENS` tokens and dealt
to buckets by it, so that suffixes with the same beginning stand together; each is weighed by one over the number of copies of
its page, and equal ones of a batch are added up before the shuffle, so that no run is too frequent for a task. This is
done twice: first by the hash's first :data:`COARSE_BITS` bits, sorted and sent as differences, which costs three bytes
a token; then by the whole hash, for those alone whose first bits repeat. So all runs of ``RUN_TOKENS`` tokens or more are
found, wherever they begin and end.

Defined cases: null html is empty and gives empty text; a null url groups with other urls without host; unclosed and
misnested tags close with their parents; unknown references stay as they are; very long pages are parsed whole, in time
that grows with their length; repeated rows and repeated page_ids are separate rows and, for the array, copies; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanji.llm.common import keep, release, settle, text_batches
from hanji.llm.minhash_dedup import bloom, may_hold
from hanji.llm.url_filter import host_of

#: Tokens by which runs are found, and distinct pages of a host that hold a repeated one.
RUN_TOKENS, RUN_PAGES = 8, 3
#: Neighbouring suffixes of which the array takes at least one: it takes every one.
SAMPLE = 1
#: Bits of a suffix's hash by which those are found that may repeat.
COARSE_BITS = 40
#: What a page marks as its article goes only if it repeats on so many distinct pages, and on this share of the host's.
MARKED_PAGES, MARKED_SHARE = 10, 0.5
#: Pages whose suffixes one bucket sorts, about.
BUCKET_PAGES = 5_000
#: Numbers of copies, of 16 bytes each, that are broadcast.
BROADCAST_CLASSES = 500_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_DROP = frozenset(
    "script style noscript template iframe object embed svg canvas nav footer aside button select input textarea label menu dialog head title".split()
)
_RAW = ("script", "style", "template", "textarea", "title", "iframe", "noscript")
#: ``p`` is closed by the start of these.
_CLOSES_P = _BLOCK - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "title"}
#: Elements that the start of another of their kind closes, and what such a search passes.
_ITEMS = frozenset("li dd dt option tr td th".split())
_BARRIER = _BLOCK - {"li", "dd", "dt", "td", "th", "tr", "p", "option"}
#: Beyond the innermost of these, an end tag of something else closes nothing.
_SCOPE = frozenset(("article", "main", "body"))
#: A class, id or role marks furniture if it is made of these words, and of those that only tell place or form.
_FURNITURE = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header "
    "login masthead menu menubar modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar widget".split()
)
_NEUTRAL = frozenset(
    "area article bar block body bottom box button buttons col column container content div fixed form global group inner item left link links list main "
    "media outer page panel post primary right row secondary section site slot small sticky sub text the thread top up user wrap wrapper".split()
)
#: Words that may also name what a page is about: such elements, and forms, go only where they hold neither an article nor
#: most of the text.
_DOUBTFUL = frozenset("banner disclaimer header login menu modal notice popup promo promoted promotion related search share sharing signup social subscribe toc toolbar widget".split())
#: With these, ``policy`` tells no more than place or form.
_POLICIES = frozenset("cookie cookies consent gdpr".split())
#: Inside an article, a header holds its title.
_IN_ARTICLE = _FURNITURE - {"header"}
#: A quote opens a value only right after the equals sign; an unquoted value may hold quotes.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|[^>])*)(?:>|\Z)",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_MARKS = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))", re.I)
_HIDDEN = re.compile(
    r"(?:^|[\s\"'/])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none|display:none))", re.I
)
_VALUES = re.compile(r"([^\s=\"'/]+\s*=\s*)(\"[^\"]*\"|'[^']*')")
_PARTS = re.compile(r"[^a-z]+")


def _is_hidden(attributes: str) -> bool:
    """By an attribute's name or a style; what other attributes say does not count."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    bare = _VALUES.sub(lambda m: m[0] if m[1].split("=")[0].strip() in ("style", "aria-hidden") else m[1] + '""', low)
    return _HIDDEN.search(bare) is not None


def _judged(tag: str, attributes: str, in_article: bool) -> str:
    """``furniture``, ``doubtful`` or empty."""
    if tag in _DROP or (tag == "header" and not in_article):
        return "furniture"
    found = "doubtful" if tag == "form" else ""
    if not attributes or tag in ("html", "body", "article", "main"):
        return found
    if _is_hidden(attributes):
        return "furniture"
    words = _IN_ARTICLE if in_article else _FURNITURE
    for m in _MARKS.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = set(filter(None, _PARTS.split(name)))
            if not parts.isdisjoint(_POLICIES):
                parts.discard("policy")
            if not words.isdisjoint(parts) and parts <= words | _NEUTRAL:
                # A role says what an element does, a class only how it is called.
                if m[1].lower() == "role" or not words & parts <= _DOUBTFUL:
                    return "furniture"
                found = "doubtful"
    return found


class _Region:
    """A doubtful element: where its blocks begin and end in each list, and whether an article or main begins in it."""

    def __init__(self, starts: list[int], marks: int):
        self.starts, self.ends, self.marks, self.holds = starts, starts, marks, False


def _without(found: list[str], regions: list[_Region], which: int) -> list[str]:
    """The blocks of a list without those of doubtful elements that hold neither an article nor most of the text."""
    if not regions:
        return found
    upto = [0]
    for x in found:
        upto.append(upto[-1] + len(x))
    change = [0] * (len(found) + 1)
    for r in regions:
        a, b = r.starts[which], r.ends[which]
        if b > a and not r.holds and 2 * (upto[b] - upto[a]) <= upto[-1]:
            change[a] += 1
            change[b] -= 1
    gone = list(accumulate(change))
    return [x for x, g in zip(found, gone, strict=False) if not g]


def blocks(page: str) -> tuple[list[str], bool]:
    """Text blocks in page order without furniture, and whether the page marks its article.

    A page's text is what its ``main`` holds; without one, what its articles hold; without either, all that is left.
    """
    lists: list[list[str]] = [[], [], []]
    outside, article_, main_ = range(3)
    held: list[str] = []
    regions: list[_Region] = []
    # Open elements: tag, within furniture, in which list, place of the innermost block element up to here, doubtful region.
    stack: list[tuple[str, bool, int, int, _Region | None]] = []
    # How many of each tag are open: at all, within the innermost scope, and since the innermost barrier. Stray tags cost no search.
    opened, scopes, barriers = Counter(), [Counter()], [Counter()]
    dropped, where, marks = False, outside, 0
    at, n = 0, len(page)

    def close() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                lists[where].append(text)

    def push(tag: str, region: _Region | None) -> None:
        opened[tag] += 1
        for inner, starts in ((scopes, _SCOPE), (barriers, _BARRIER)):
            if tag in starts:
                inner.append(Counter())
            inner[-1][tag] += 1
        block = len(stack) if tag in _BLOCK else stack[-1][3] if stack else -1
        stack.append((tag, dropped, where, block, region))

    def pop_to(k: int) -> None:
        nonlocal dropped, where
        if stack[-1][3] >= k:
            close()
        while len(stack) > k:
            tag, dropped, where, _, region = stack.pop()
            if region:
                region.ends, region.holds = [len(x) for x in lists], marks > region.marks
            opened[tag] -= 1
            for inner, starts in ((scopes, _SCOPE), (barriers, _BARRIER)):
                inner[-1][tag] -= 1
                if tag in starts:
                    inner.pop()

    def innermost(tag: str) -> int:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            if not dropped:
                held.append(page[at:])
            break
        if m.start() > at and not dropped:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] and (tag in _SCOPE or tag == "html" or scopes[-1][tag] > 0):
                pop_to(innermost(tag))
            elif tag in _BLOCK:
                close()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _CLOSES_P and stack and stack[-1][3] >= 0 and stack[stack[-1][3]][0] == "p":
            pop_to(stack[-1][3])
        if tag in _ITEMS and barriers[-1][tag] > 0:
            pop_to(innermost(tag))
        if tag in _BLOCK:
            close()
        if tag in _VOID or (m[3].endswith("/") and tag not in _BLOCK):
            continue
        found = "" if dropped else _judged(tag, m[3], where != outside)
        region = None
        if found == "doubtful" and tag in _BLOCK:
            region = _Region([len(x) for x in lists], marks)
            regions.append(region)
        push(tag, region)
        if tag in ("article", "main") and not dropped:
            where, marks = max(where, main_ if tag == "main" else article_), marks + 1
        # Within a line, a doubtful element cannot be told from its neighbours later.
        dropped = dropped or found == "furniture" or (found == "doubtful" and region is None)
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            if end:
                at = end.end()
                pop_to(len(stack) - 1)
            else:
                break
    close()
    if stack:
        pop_to(0)
    for which in (main_, article_):
        if left := _without(lists[which], regions, which):
            return left, True
    return _without(lists[outside], regions, outside), False


# Token runs

_STEP = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Tokens:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = 200_000):
        self.known, self.limit = {}, limit

    def of(self, page: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all tokens of a page's blocks and the number of tokens of each block."""
        split = [b.split(" ") for b in page]
        if len(self.known) > self.limit:
            self.known.clear()
        known, out = self.known, []
        for words in split:
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                out.append(h)
        return np.array(out, np.uint64), np.array([len(x) for x in split], np.int64)


def suffixes(tokens: np.ndarray, host: int, run: int = RUN_TOKENS) -> np.ndarray:
    """For each suffix of at least ``run`` tokens a hash of its first ``run`` tokens and its host."""
    out = np.full(max(0, len(tokens) - run + 1), np.uint64(host & (1 << 64) - 1), np.uint64)
    for k in range(run if len(out) else 0):
        out += tokens[k : k + len(out)] * np.uint64(pow(_STEP, k + 1, 1 << 64))
    return _mix(out)


def sampled(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the suffixes that the array takes, which are all, whatever the blocks' ``lengths``."""
    return np.arange(len(keys))


def coarse(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - COARSE_BITS)


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte, so that the upper bytes, mostly zeros, are compressed in the shuffle."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def without(page: list[str], keys: np.ndarray, lengths: np.ndarray, repeated: np.ndarray, run: int = RUN_TOKENS) -> list[str]:
    """The page's blocks without the tokens of the runs in ``repeated``; empty blocks go."""
    at = np.flatnonzero(np.isin(keys, repeated))
    edge = np.zeros(int(lengths.sum()) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    stays = np.cumsum(edge)[:-1] == 0
    out, first = [], 0
    for block, n in zip(page, lengths.tolist(), strict=True):
        own = stays[first : first + n]
        if own.all():
            out.append(block)
        elif own.any():
            out.append(" ".join(w for w, ok in zip(block.split(" "), own.tolist(), strict=True) if ok))
        first += n
    return out


SEPARATOR = "\n\n"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host and class (hashes of the host and of its name with the page's tokens), open (no mark), blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(h or "") for h in batch.column("html").to_pylist()]
            hosts = batch.column("host").to_pylist()
            classes = [xxhash.xxh64_intdigest("\n".join((host, " ".join(b)))) for host, (b, _) in zip(hosts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(np.array([xxhash.xxh64_intdigest(h) for h in hosts], np.uint64).view(np.int64)),
                    pa.array(np.array(classes, np.uint64).view(np.int64)), pa.array([not m for _, m in found]), pa.array([b for b, _ in found], pa.list_(pa.string())),
                ],
                names=["page_id", "url", "host", "class", "open", "blocks"],
            )
        release()

    text_batches(pages.sparkSession)
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(work, "page_id long, url string, host long, class long, open boolean, blocks array<string>")


def repeated(pages: DataFrame, buckets: int, among: DataFrame | None = None) -> DataFrame:
    """(key, pages): suffix beginnings that at least :data:`RUN_PAGES` distinct pages of a host hold, and how many.

    ``pages`` has host, copies, blocks. Keys are :func:`coarse`, and may be of several beginnings; with those ``among`` which
    all that repeat must be, they are whole.
    """
    bits = pages.sparkSession.sparkContext.broadcast(bloom(among.select(F.col("key").alias("id")))) if among is not None else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            found, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
            for host, copies, page in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                ids, lengths = tokens.of(page)
                keys = suffixes(ids, host)
                keys = keys[sampled(keys, lengths)]
                keys = np.unique(coarse(keys) if bits is None else keys[may_hold(bits.value, coarse(keys).view(np.int64))])
                found.append(keys)
                weights.append(np.full(len(keys), 1 / copies, np.float32))
            keys, of = np.unique(np.concatenate(found), return_inverse=True)
            sums = np.bincount(of, weights=np.concatenate(weights), minlength=len(keys)).astype(np.float32)
            # Most suffixes are of one page; their weights need not travel. Low bits deal: they are even in both kinds of keys.
            part = (keys & np.uint64(0xFFFFF)).astype(np.int64) % buckets * 2 + (sums != 1)
            order = np.argsort(part, kind="stable")
            here, first = np.unique(part[order], return_index=True)
            cuts = [*first.tolist(), len(order)]
            rows = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            weighed = [sums[r].tobytes() if p % 2 else None for r, p in zip(rows, here.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array((here // 2).astype(np.int32)), pa.array([packed(keys[r]) for r in rows], pa.binary()), pa.array(weighed, pa.binary())], names=["bucket", "keys", "sums"])
        release()

    def sort(bucket: pa.Table) -> pa.Table:
        both = list(zip(bucket.column("keys").to_pylist(), bucket.column("sums").to_pylist(), strict=True))
        keys = np.concatenate([unpacked(k) for k, _ in both])
        sums = np.concatenate([np.frombuffer(w, np.float32) if w else np.ones(len(k) // 8, np.float32) for k, w in both])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
        held = np.add.reduceat(sums[order].astype(np.float64), first)
        enough = held > RUN_PAGES - 0.5
        return pa.table({"key": pa.array(keys[first[enough]].view(np.int64)), "pages": pa.array(np.rint(held[enough]))})

    dealt = pages.select("host", "copies", "blocks").mapInArrow(deal, "bucket int, keys binary, sums binary")
    return keep(dealt.groupBy("bucket").applyInArrow(sort, "key long, pages double"))


def holders(pages: DataFrame, runs: DataFrame, hosts: DataFrame) -> DataFrame:
    """(class, key, goes): which of the repeated ``runs`` each distinct page holds, and whether they go from it.

    A Bloom filter of the runs is sent to the pages, so that only what it lets pass meets them in a join.
    """
    bits = pages.sparkSession.sparkContext.broadcast(bloom(runs.select(F.col("key").alias("id"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, table = Tokens(), bits.value
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                ids, lengths = tokens.of(row[3])
                keys = suffixes(ids, row[0])
                keys = np.unique(keys[sampled(keys, lengths)]).view(np.int64)
                out.append(keys[may_hold(table, keys)])
            counts = [len(k) for k in out]
            names = {c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts)) for c in ("host", "class", "open")}
            yield pa.RecordBatch.from_arrays([*names.values(), pa.array(np.concatenate([np.zeros(0, np.int64), *out]))], names=["host", "class", "open", "key"])

    held = pages.select("host", "class", "open", "blocks").mapInArrow(work, "host long, class long, open boolean, key long")
    met = held.distinct().join(runs, "key").join(hosts, "host")
    enough = (F.col("pages") >= MARKED_PAGES) & (F.col("pages") >= MARKED_SHARE * F.col("classes"))
    return keep(met.select("class", "key", (F.col("open") | enough).alias("goes")))


def with_runs(pages: DataFrame, runs: DataFrame, name: str, how: str) -> DataFrame:
    """Pages with the keys of their class's runs as an array, which is at most as long as the page."""
    return pages.join(runs.groupBy("class").agg(F.collect_set("key").alias(name)), "class", how)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text. Each page is parsed once; its blocks are written to the shared folder."""
    found = settle(parsed(pages), compression="zstd")
    every = found.groupBy("host", "class").agg(F.count("*").alias("copies"))
    hosts = keep(every.groupBy("host").agg(F.count("*").alias("classes"), F.sum("copies").alias("rows")))
    buckets = 4 + (hosts.agg(F.sum("rows")).first()[0] or 0) // BUCKET_PAGES
    hosts = hosts.select("host", "classes")
    copied = keep(every.filter("copies > 1").select("class", "copies"))
    # Pages travel to the numbers of their copies only where these are too many to travel to the pages.
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_CLASSES else copied
    weighed = found.join(copied, "class", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    marked = found.select("page_id", "url", "blocks", F.lit(None).cast("array<bigint>").alias("gone"), "host")
    runs = repeated(weighed, buckets)
    if not runs.isEmpty():
        going = holders(found, repeated(weighed, buckets, runs), hosts).filter("goes")
        if not going.isEmpty():
            marked = with_runs(found, going, "gone", "left").select("page_id", "url", "blocks", "gone", "host")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            texts = []
            for page, gone, host in zip(*(batch.column(c).to_pylist() for c in ("blocks", "gone", "host")), strict=True):
                if gone:
                    ids, lengths = tokens.of(page)
                    page = without(page, suffixes(ids, host), lengths, np.array(gone, np.int64).view(np.uint64))
                texts.append(SEPARATOR.join(page))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
        release()

    return marked.mapInArrow(work, "page_id long, url string, text string")


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
