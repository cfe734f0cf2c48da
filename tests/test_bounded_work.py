"""Work that grows no faster than the input: what is computed once, in bulk, or a few MB at a time."""

import random
import zlib

import pandas as pd

from hanji.functions import korean
from hanji.plans import engine


def test_trigrams_are_hashed_in_bulk_as_one_by_one():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choices("ab \n한é😀\x00", k=rng.randrange(9)))
        assert engine.trigram_checksums(t).tolist() == [zlib.crc32(t[j : j + 3].encode()) for j in range(max(1, len(t) - 2))]


def test_a_pair_of_parts_is_indexed_once_a_batch(monkeypatch):
    asked = []
    plain = korean.index_text
    monkeypatch.setattr(korean, "index_text", lambda *parts: asked.append(parts) or plain(*parts))
    a, b = pd.Series(["제 1 조", "제 2 조", None] * 40), pd.Series(["src0", "src1", "x"] * 40)
    got = korean.index_text_udf.func(a, b)
    assert got.tolist() == [plain(x, y) for x, y in zip(a, b)] and len(asked) == 3


def test_small_archives_share_partitions(tmp_path):
    import zipfile

    from hanji.sources import connectors

    for n in range(100):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr("a.txt", f"text {n}")
    reader = connectors.ZipReader(f"file://{tmp_path}")
    dealt = reader.partitions()
    assert len(dealt) == 1
    assert sorted(bytes(row[5]).decode() for part in dealt for row in reader.read(part)) == sorted(f"text {n}" for n in range(100))


def test_rows_of_files_leave_a_task_a_few_mb_at_a_time(monkeypatch):
    from hanji.sources import extract

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, work, _):
            return work

    monkeypatch.setattr(extract, "BATCH_BYTES", 100)
    batch = pd.DataFrame({"path": [f"{i}.txt" for i in range(50)], "content": [b"plain words " * (i % 4) for i in range(49)] + [None]})
    made = list(extract.extract(Files())(iter([batch])))
    assert len(made) > 5 and max(len(m) for m in made) < 20
    assert [p for m in made for p in m["path"]] == batch["path"].tolist()


def test_white_space_at_the_ends_is_what_the_expression_matches(spark):
    from pyspark.sql import functions as F

    from hanji.functions.text import strip

    kinds = [chr(c) for c in (*range(0x0, 0x300), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    rows = spark.createDataFrame([(f"{c}{c} a{c}b {c}\n",) for c in kinds] + [(f"{c}",) for c in kinds] + [(None,), ("",), (" \n",)], "t string")
    assert rows.filter(~strip("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp" not in rows.select(strip("t"))._jdf.queryExecution().optimizedPlan().toString()
