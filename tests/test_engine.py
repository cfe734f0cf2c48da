"""Operators on the literal fixtures of FIXTURES.md and against small models in plain Python."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from hanji import config
from hanji.functions import korean
from hanji.functions import text as T
from hanji.operators import boolean, chunking, evaluate, grounding, index, limits, retrieve, stores
from hanji.plans.engine import Engine, choose_model
from hanji.sources import extract, files

RULES = ["인사규정 제1조 목적", "취업규칙 근로시간 휴식", "복리후생 건강검진 지원", "출장규정 국내출장 정산", "보안규정 정보보호 준수사항"]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(list(enumerate(RULES)), "doc_id long, text string")


def test_bm25_scores(rules):
    got = {r["doc_id"]: r["score"] for r in index.search(index.build(rules), ["인사규정", "missing"]).collect()}
    assert got == {0: pytest.approx(1.386294, abs=1e-6)}
    assert got == {r["doc_id"]: pytest.approx(r["score"]) for r in index.scan(rules, ["인사규정", "missing"]).collect()}
    assert index.search(index.build(rules), []).count() == 0


def test_adding_a_document_keeps_frequencies(spark, rules):
    before = {tuple(r) for r in index.term_frequencies(rules).collect()}
    more = rules.unionByName(spark.createDataFrame([(9, "인사규정 추가")], "doc_id long, text string"))
    assert before <= {tuple(r) for r in index.term_frequencies(more).collect()}


def test_rank_fusion_ignores_score_scale(spark):
    hits = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (1, 2, 9.0), (1, 3, 1.0)], "variant int, doc_id long, score double")
    a = retrieve.rank_fusion(hits, top_k=None).collect()
    b = retrieve.rank_fusion(hits.withColumn("score", F.col("score") * 7), top_k=None).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert dict(map(tuple, a))[2] == pytest.approx(1 / 62 + 0.6 / 61)


def test_fusion_and_filters(spark):
    chunks = spark.createDataFrame([(0, "vacation policy guide", "a.txt", "id-a"), (1, "security policy guide", "b.txt", "id-b")], "doc_id long, text string, source string, file_id string")
    engine = Engine(chunks, index.build(chunks))
    assert [r["file_id"] for r in engine.search("vacation", file_id="id-a").collect()] == ["id-a"]
    assert [r["source"] for r in engine.search("policy", source="b.txt").collect()] == ["b.txt"]
    assert engine.search("policy", hybrid=False).count() == 0
    left = stores.without_files(chunks.withColumn("path", F.lit("")), spark.createDataFrame([("", "id-a", "")], "path string, file_id string, source string"))
    assert [r["source"] for r in left.collect()] == ["b.txt"]
    with pytest.raises(ValueError):
        engine.search("x")


@pytest.mark.parametrize(
    ("raw", "want"),
    [("제 41 조", "제41조"), ("제 8 의 4 조 제 6 항", "제8의4조 제6항"), ("7 천 만 원", "7000만원"), (" 별표   9 ", "별표 9"), ("2,500만원", "2500만원"), ("구억원", "9억원"), ("6 백만원과 사천만원", "600만원과 4000만원"), ("팔십만원", "팔십만원"), ("", ""), (None, "")],
)
def test_canonical(raw, want):
    assert korean.canonical(raw) == want


def test_variants():
    assert korean.variants("50000만원") == ["50000만원", "5억원", "50천만원"]
    assert "70000만원" in korean.variants("칠억원") and "12천만원 이하" in korean.variants("12000만원 이하")
    assert {"첨부5 서식", "첨부 5 서식"} <= set(korean.variants("첨부  5 서식"))
    assert "9급에서8급으로승진2년" in korean.variants("9급 공무원이 8급까지 2년") and "부칙 적용" in korean.variants("부  칙 적용")
    assert "승진최저소요연수" in korean.variants("승진에 드는 최소 소요기간") and "승진최저소요연수" not in korean.variants("승진 절차")
    assert korean.variants("") == korean.variants(None) == []
    assert korean.query_variants("Leave  rules", hyde=False) == ["Leave  rules", "Leave rules", "leaverules"]
    assert len(korean.query_variants("출장비 정산 서류 80000만원 별첨 7")) == config.MAX_VARIANTS


def test_boolean_queries():
    q = boolean.parse('"Exact  Phrase" a AND b OR c NOT d NOT "e f"')
    assert (q.phrases, q.clauses, q.excludes) == (["exact phrase"], [["a", "b"], ["c"]], ["d", "e f"])
    assert T.parse_regex("x" * 81) is None


def split_model(text, size, overlap):
    overlap, size = min(overlap, size // 2), max(size, 100)
    done, cur = [], ""
    for p in (x.strip() for x in text.split("\n\n")):
        if not p:
            continue
        if len(cur) + len(p) + 2 <= size:
            cur = f"{cur}\n\n{p}" if cur else p
            continue
        if cur:
            done.append(cur)
        if len(p) > size:
            done += [s for i in range(0, len(p), size - overlap) if (s := p[i : i + size]).strip()]
            cur = ""
        else:
            cur = f"{done[-1][-overlap:]}\n\n{p}" if done and overlap else p
    return done + ([cur] if cur.strip() else [])


def test_split_equals_model(spark):
    rng = random.Random(5)
    texts = ["", "  ", "\n\n".join("가나다 " * rng.randint(0, 60) for _ in range(9))] + ["\n\n".join("ab c" * rng.randint(0, 120) for _ in range(rng.randint(1, 12))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for size, overlap in ((200, 20), (100, 80), (50, 0)):
        got = {r["i"]: r["c"] for r in df.select("i", chunking.split(F.col("t"), size, overlap).alias("c")).collect()}
        assert got == {i: split_model(t, size, overlap) for i, t in enumerate(texts)}


def test_chunks(spark):
    text = "제1조(목적) 이 규정은 연차휴가에 관한 사항을 정한다.\n\n제2조(연차휴가) ① 직원의 연차유급휴가는 15일로 한다.\n② 1년 미만 근무자는 월 1일을 부여한다."
    rows = spark.createDataFrame([(text,), ("부칙\n이 규정은 2024년부터 시행한다.\n| 항목 | 값 |\n| --- | --- |\n| 연차 | 15일 |",), (None,)], "t string")
    got = rows.select(chunking.structured_chunks(F.col("t")).alias("c")).collect()
    assert [c["article_no"] for c in got[0]["c"]] == ["제1조", "제2조"] and {c["chunk_type"] for c in got[0]["c"]} == {"article"}
    assert {c["chunk_type"] for c in got[1]["c"]} == {"table", "supplementary"} and "15일" in got[1]["c"][0]["text"]
    assert got[2]["c"] == []


def test_dense_numbers(spark):
    rows = spark.range(0, 5000, 3).withColumn("k", -F.col("id"))
    got = chunking.numbered(rows, ["k"], parts=7).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(got)))
    assert all(r["doc_id"] == len(got) - 1 - r["id"] // 3 for r in got)


def test_grounding(spark):
    rows = spark.createDataFrame([("연차유급휴가는 15일을 부여합니다.", ["제2조 연차유급휴가 15일을 부여한다."]), ("x" * 20, []), ("- a b\n- 연차는", ["연차는"])], "answer string, evidence array<string>")
    a, b, c = grounding.verify(rows).collect()
    assert (a["score"], a["supported"], a["total"]) == (0.61, 1, 1)
    assert (b["score"], b["total"]) == (0.0, 0)
    assert c["total"] == 2


def test_guard_replaces_weak_answers(spark):
    rows = spark.createDataFrame([("made up", 2, 0.0), ("good [1]", 4, 0.9), ("any", 0, 0.9)], "answer string, n_chunks int, score double")
    weak, good, none = grounding.guard(rows, config.Guard(disclaimer="check")).collect()
    assert weak["refused"] and weak["answer"].startswith(config.REFUSAL) and weak["answer"].endswith("check")
    assert not good["refused"] and none["refused"] and none["confidence"] == 0.0


def test_context_keeps_a_prefix(spark):
    rows = spark.createDataFrame([(q, r, "x" * n) for q, ns in enumerate([[7000, 5], [3000, 2999, 2, 1]]) for r, n in enumerate(ns, 1)], "q int, rank int, block string")
    got = sorted((r["q"], r["rank"]) for r in retrieve.pack_context(rows, by=["q"]).collect())
    assert got == [(0, 1), (1, 1), (1, 2)]


def limiter_model(stamps, limit, seconds):
    log, ok = [], 0
    for t in sorted(stamps):
        log = [s for s in log if s > t - seconds]
        if len(log) < limit:
            log.append(t)
            ok += 1
    return ok, len(stamps) - ok


def test_limiter_and_history_equal_models(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 3)}", 1_700_000_000 + rng.randint(0, 900)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    got = {r["key"]: (r["allowed"], r["blocked"]) for r in limits.rate_limited(df, key="k", at="at", limit=5, seconds=60).collect()}
    assert got == {k: limiter_model([s for q, s in rows if q == k], 5, 60) for k in got}
    stored = {r["query"]: r["stored"] for r in limits.stored_history(df, query="k", at="at").collect()}
    for k, n in stored.items():
        last, want = None, 0
        for s in sorted(s for q, s in rows if q == k):
            if last is None or s - last >= 300:
                last, want = s, want + 1
        assert n == want


def test_cache():
    now = [0.0]
    cache = limits.ResultCache(5, 2.0, clock=lambda: now[0])
    for i in range(6):
        cache.put(i, [{"source": f"file{i}.txt"}])
    assert cache.get(0) is None and cache.get(5) is not None
    assert cache.stats()["hit_rate"] == 50.0
    assert cache.invalidate("file3.txt") == 1
    now[0] = 2.3
    assert cache.get(1) is None


def test_queue():
    queue = limits.SearchQueue(2)
    assert queue.acquire(0.01) and queue.acquire(0.01) and not queue.acquire(0.01)
    assert queue.stats() == {"active": 2, "processed": 0, "rejected": 1}


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, 1, True), (1, 1, False), (1, 2, True), (2, 1, False)], "query_id int, rank int, relevant boolean")
    got = evaluate.corpus_metrics(spark.createDataFrame([(0,), (1,), (2,)], "query_id int"), evaluate.query_metrics(ranked, 5)).first()
    assert (got["recall"], got["mrr"]) == (pytest.approx(2 / 3, abs=1e-6), pytest.approx(0.5))


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


HWPX = """<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:run><hp:t>첫 문단</hp:t></hp:run></hp:p><hp:p><hp:run><hp:tbl>
<hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>A1</hp:t></hp:run></hp:p></hp:subList></hp:tc><hp:tc><hp:subList><hp:p><hp:run><hp:t>B1</hp:t></hp:run></hp:p></hp:subList></hp:tc></hp:tr>
<hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>A2</hp:t></hp:run></hp:p></hp:subList></hp:tc><hp:tc><hp:subList><hp:p><hp:run><hp:t>B2</hp:t></hp:run></hp:p></hp:subList></hp:tc></hp:tr>
</hp:tbl></hp:run></hp:p><hp:p><hp:run><hp:t>둘째 문단</hp:t></hp:run></hp:p></hs:sec>"""


def test_extractors():
    got = extract.extract_one("/d/x.hwpx", _zip({"Contents/section0.xml": HWPX, "Contents/section1.xml": "<broken"}))
    assert got["error"] is None and "A1 | B1" in got["text"] and "둘째 문단" in got["text"]
    assert got["metadata"]["table_count"] == "1" and len(got["warnings"]) == 1
    assert "HWPX ZIP 오류" in extract.extract_one("/d/y.hwpx", b"nope")["error"]
    assert extract.extract_one("/d/a.exe", b"x")["error"]
    ns = 'xmlns:w="w"'
    doc = f"<w:document {ns}><w:body><w:p><w:r><w:t>본문</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    assert extract.extract_one("/d/a.docx", _zip({"word/document.xml": doc}))["text"] == "본문\n\nc1 | c2"
    book = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="급여" r:id="rId1"/><sheet name="빈" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/s1.xml"/><Relationship Id="rId2" Target="worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>이름</t></si></sst>",
        "xl/worksheets/s1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": "<worksheet><sheetData/></worksheet>",
    }
    assert extract.extract_one("/d/a.xlsx", _zip(book))["text"] == "[시트: 급여]\n이름 | 5"
    assert "인사규정 제1조" in extract.extract_one("/d/a.hwp", b"\x00\x01" + "인사규정 제1조".encode("utf-16-le") + b"\x00\x02")["text"]


def test_spans_fill_the_grid():
    made = extract.grid([[{"text": "a", "row_span": 2}, {"text": "b"}], [{"text": "c"}]], 0)
    assert made["cols"] == 2 and made["text_rows"] == ["a | b", "| c"]


def test_folder_scan_ignores_case(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("A.TXT", "sub/b.txt", "c.exe"):
        (tmp_path / name).write_text("x")
    assert sorted(r["name"] for r in files.folder(spark, str(tmp_path)).select("name").collect()) == ["A.TXT", "b.txt"]
    assert sorted(r["key"] for r in files.listing(spark, str(tmp_path)).collect()) == ["A.TXT", "sub/b.txt"]


def test_paths_stay_inside():
    assert files.safe_folder("/data/x", ["/data"]) == "/data/x"
    for bad in ("/data/../etc", "/other", "//data", ""):
        with pytest.raises(ValueError):
            files.safe_folder(bad, ["/data"])


def test_model_choice():
    class M:
        def __init__(self, name, ok):
            self.name, self.ok = name, ok

        def healthy(self):
            return self.ok

    assert choose_model(M("a", False), [M("b", True)]).name == "b"
    assert choose_model(M("a", False), [M("b", False)]).name == "a"


def test_answer(spark):
    rows = spark.createDataFrame(
        [("f1", "휴가규정.txt", "/휴가규정.txt", "제1조(목적) 이 규정은 연차휴가에 관한 사항을 정한다.\n\n제2조(연차휴가) 직원의 연차유급휴가는 15일로 한다.")], "file_id string, source string, path string, text string"
    )
    chunks = chunking.chunk_table(rows).withColumn("doc_id", F.col("chunk_id").cast("long")).persist()
    engine = Engine(chunks, index.build(chunks).persist())

    class Model:
        name = "echo"

        def complete(self, messages):
            return "직원의 연차유급휴가는 15일로 한다[1]"

    engine.model = Model()
    found = engine.answer("제2조")
    assert not found["refused"] and found["citations"][0]["article_no"] == "제2조" and found["confidence"] > 0.35
    assert [r["article_no"] for r in engine.get_article("연차유급").collect()] == ["제2조"]
    assert engine.status()["chunks"] == 2


def test_index_survives_a_round_trip(spark, rules, tmp_path):
    index.build(rules).save(str(tmp_path / "i"))
    got = index.search(index.Index.load(spark, str(tmp_path / "i")), ["보안규정", "정보보호"]).collect()
    assert [r["doc_id"] for r in got] == [4]


def test_refresh_of_changed_and_deleted_files(spark, tmp_path):
    from hanji.streaming.jobs import current, refresh

    def chunk(rows):
        return chunking.chunk_table(rows.select(T.file_id("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("source"), "path", "text"))

    def held():
        return sorted((r["source"], r["text"]) for r in current(spark, target).collect())

    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    assert refresh(spark, str(folder), target, extract.extract, chunk) == {"process": 0, "cached": 0, "removed": 0}
    assert held() == []
    for name in ("a.txt", "b.txt", "c{x}[y].txt", "skipped.exe"):
        (folder / name).write_text(f"text of {name[0]}")
    assert refresh(spark, str(folder), target, extract.extract, chunk) == {"process": 3, "cached": 0, "removed": 0}
    (folder / "a.txt").write_text("another text of a")
    (folder / "b.txt").unlink()
    (folder / "d.txt").write_text("text of d")
    # What a call that broke off left behind is not seen, and is overwritten.
    (tmp_path / "out" / "manifest" / "v3").mkdir()
    assert held() == [("a.txt", "text of a"), ("b.txt", "text of b"), ("c{x}[y].txt", "text of c")]
    assert refresh(spark, str(folder), target, extract.extract, chunk) == {"process": 2, "cached": 1, "removed": 1}
    expected = [("a.txt", "another text of a"), ("c{x}[y].txt", "text of c"), ("d.txt", "text of d")]
    assert held() == expected
    assert refresh(spark, str(folder), target, extract.extract, chunk) == {"process": 0, "cached": 3, "removed": 0}
    assert held() == expected


def test_archive_without_free_names(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(1001):
            z.writestr(f"{i}/same.txt", "x")
    rows = files.archive_members(spark.createDataFrame([("z.zip", bytearray(out.getvalue()))], "path string, content binary"), entries=2000).collect()
    names = [r["name"] for r in rows if r["status"] == "success"]
    assert len(names) == len(set(names)) == 1000 and "same_999.txt" in names
    assert [r["member"] for r in rows if r["status"] == "failed"] == ["1000/same.txt"]


def test_file_stats_round_trip(spark, tmp_path):
    stored = spark.createDataFrame([("/d/a.txt", "a.txt", ".txt", 5, "완료", 3, "", 1.5, "v1", "id", "?"), ("/d/b.TXT", *[None] * 9, "?")], files.STATS + ", unknown string")
    files.save_file_stats(stored, str(tmp_path / "stats"))
    a, b = files.file_stats(spark, str(tmp_path / "stats")).orderBy("path").collect()
    assert tuple(a) == tuple(stored.orderBy("path").first())[:-1]
    assert (b["name"], b["extension"], b["size"], b["status"], b["chunks"]) == ("b.TXT", ".txt", 0, config.STATUSES[0], 0)
