"""Every registered engine query against its SQL in DuckDB on the smallest tables; those without SQL must run."""

import datetime
import decimal
import os
import re

import duckdb
import pytest

from hanji.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    cur = duck.execute(catalogue.ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert got == sorted(tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall())


def claims_model(text):
    found = []
    for line in filter(None, map(str.strip, (text or "").splitlines())):
        if line.startswith("- "):
            found.append(line[2:].strip())
        elif not line.startswith(("|", "#")):
            found += [s for s in map(str.strip, re.split(r"(?<=[.!?。])\s+|[.。]\s*", line)) if len(s) > 12]
    whole = (text or "").strip()
    return found or ([whole] if len(whole) > 12 else [])


def test_claims_of_all_documents_equal_model(spark, tmp_path):
    odd = ["- one\n- two bullets here", "Is this a question? Yes it is one! And the end of it.", "short. one\nand two", "# only a heading of a text\n| a | table |", None, "", "tiny"]
    spark.createDataFrame([(i, t, "a", "en") for i, t in enumerate(odd)], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for sf in (str(tmp_path), SF):
        docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
        got = {}
        for r in catalogue.QUERIES["sf33_claims_all"](spark, sf).collect():
            got.setdefault(r["doc_id"], []).extend([] if r["claim"] is None else [(r["position"], r["claim"])])
        assert {i: [c for _, c in sorted(v)] for i, v in got.items()} == {i: claims_model(t) for i, t in docs.items()}


def test_sizes_beyond_a_terabyte_equal_sql(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (1, 20_000, 33_300, 40_000, 1_200_000)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalogue.QUERIES["sf29_human_size"](spark, str(tmp_path)).select("p_partkey", "size").collect())
    assert got == sorted(con.execute(catalogue.ORACLES["sf29_human_size"]).fetchall()) and got[-1][1].endswith("GB")


def test_variant_cap_counts_all_forms(spark, tmp_path):
    texts = ["a A  b", "a b c d e f", "a b c d e f g", "x " * 50 + "a b c d e f", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalogue.QUERIES["top09_variant_cap"](spark, str(tmp_path)).select("doc_id", "cut", "n").collect())
    assert got == sorted(con.execute(f"SELECT doc_id, cut, n FROM ({catalogue.ORACLES['top09_variant_cap']})").fetchall())
    assert got[:4] == [(0, False, 3), (1, False, 6), (2, True, 6), (3, True, 6)]
