import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks import ingest
from lodeworks.functions import models
from lodeworks.operators import chunking
from lodeworks.operators.store import ChunkStore
from lodeworks.settings import Settings, settings
from lodeworks.sources import listing, pages

LONG = " ".join(f"The office answers question number {i} on every working day." for i in range(40))
TARGETS = [
    {"key": "about", "url": "https://e.com/about", "crawl_type": "api_json", "frequency": "weekly"},
    {"key": "staff", "url": "https://e.com/staff", "crawl_type": "api_staff", "frequency": "monthly"},
    {"key": "lost", "url": "https://e.com/lost", "crawl_type": "api_json", "frequency": "weekly"},
]


def site(folder, about):
    folder.mkdir(exist_ok=True)
    put = lambda url, x: (folder / ingest.page_name(url)).write_text(json.dumps(x), encoding="utf-8")
    put("https://e.com/about", {"title": "About", "content": about})
    put("https://e.com/staff", [{"staff": {"id": i, "name": f"Person {i}", "surName": "Of the office for all matters of students", "email": f"p{i}@e.com"}} for i in range(3)])
    for i in (1, 2):
        put(f"https://e.com/get?id={i}", {"text": f"<p>News number {i}: {LONG[:300]}</p>"})


def items(folder, ids):
    folder.mkdir(exist_ok=True)
    (folder / "page_1.json").write_text(json.dumps([{"id": i, "title": f"News {i}", "updated": "2024"} for i in sorted(ids, reverse=True)]))


def test_a_run_and_what_runs_after_it(spark, tmp_path):
    listing.register(spark)
    site(tmp_path / "site", LONG)
    items(tmp_path / "list", [1, 2, 3])  # 3 has no detail
    from lodeworks.sources import catalog

    targets, store = catalog.catalogue(spark, TARGETS), ChunkStore(spark, str(tmp_path / "store"), 8)
    asked = []
    reader = lambda: spark.read.format("listing").option("folder", str(tmp_path / "list")).load()
    own = Settings(request_delay_s=0.001)
    go = lambda mode, at: ingest.run(spark, mode, targets, store, ingest.folder_fetch(str(tmp_path / "site")), at, reader(), "https://e.com/get?id={id}", "https://e.com", own=own)
    done = go("full", "2024-01-01T00:00:00Z")
    assert done["targets"] == 3 and done["errors"] == 1 and done["announcements"] == 3
    rows = store.read().collect()
    assert len(rows) == done["chunks"] and {r["source_key"] for r in rows} == {"about", "staff", chunking.ANNOUNCEMENTS}
    assert all(len(r["dense"]) == 64 and r["sparse"] for r in rows)
    about = sorted(r["chunk_index"] for r in rows if r["source_key"] == "about")
    assert about == list(range(len(about))) and len(about) >= 3
    assert {r["doc_id"] for r in rows if r["source_key"] == chunking.ANNOUNCEMENTS} == {"1", "2"}
    # the page shrinks: its last chunks go; the other targets aren't asked in this mode
    site(tmp_path / "site", LONG[:500])
    assert go("weekly", "2024-01-02T00:00:00Z") | {"chunks": 0} == {"mode": "weekly", "targets": 2, "errors": 1, "announcements": 0, "chunks": 0}
    left = [r["chunk_index"] for r in store.read().filter("source_key = 'about'").collect()]
    assert left == [0] and store.read().filter("source_key = 'staff'").count() > 0
    items(tmp_path / "list", [1, 2, 3])
    assert go("daily", "2024-01-03T00:00:00Z")["announcements"] == 1 and not asked  # 3 still isn't known, as it has no text
    assert ingest.known_announcements(store) == 2


def test_the_command(tmp_path):
    site(tmp_path / "site", LONG)
    (tmp_path / "targets.json").write_text(json.dumps(TARGETS))
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.lodeworks.request_delay_s=0.001 pyspark-shell"}
    cmd = [sys.executable, "-m", "lodeworks.ingest", "--mode", "monthly", "--targets", str(tmp_path / "targets.json"), "--pages", str(tmp_path / "site")]
    done = subprocess.run([*cmd, "--store", str(tmp_path / "store")], capture_output=True, text=True, env=env, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().split("\n")[-1]) == {"mode": "monthly", "targets": 1, "errors": 0, "announcements": 0, "chunks": 1}


def test_settings(spark):
    assert settings(spark) == Settings()
    spark.conf.set("spark.lodeworks.retrieve", "30")
    spark.conf.set("spark.lodeworks.grade_answers", "No")
    try:
        own = settings(spark)
        assert own.retrieve == 30 and own.grade_answers is False and own.rerank == 3
        for name, bad in (("retrieve", "many"), ("grade_answers", "perhaps"), ("rerank", "0"), ("similarity", "1.5"), ("chunk_overlap", "1000")):
            before = spark.conf.get(f"spark.lodeworks.{name}", None)
            spark.conf.set(f"spark.lodeworks.{name}", bad)
            with pytest.raises(ValueError, match=name):
                settings(spark)
            spark.conf.set(f"spark.lodeworks.{name}", before) if before else spark.conf.unset(f"spark.lodeworks.{name}")
    finally:
        spark.conf.unset("spark.lodeworks.retrieve")
        spark.conf.unset("spark.lodeworks.grade_answers")


def test_batches_by_length_under_a_budget(spark):
    lengths = [3, 90, 1, 40, 41, 7, 0, 500, 2]
    batches = models.packed(lengths, 100)
    assert sorted(i for b in batches for i in b) == list(range(9))
    assert all(len(b) * max(lengths[i] for i in b) <= 100 or len(b) == 1 for b in batches) and batches[0] == [7] and len(batches) == 4
    seen = []

    class Model(models.HashEmbedder):
        def encode(self, texts):
            seen.append(texts)
            return super().encode(texts)

    import pandas as pd

    pdf = pd.DataFrame({"id": range(5), "text": ["a b c", None, "a", "  ", "x y z w " * 50]})
    out = next(models.encode_packed(Model(8), 64)([pdf]))
    assert out["id"].tolist() == [0, 1, 2, 3, 4] and out["dense"].isna().tolist() == [False, True, False, True, False]
    assert np.allclose(out["dense"][0], models.HashEmbedder(8).encode(["a b c"])[0]) and out["sparse"][2] == {"a": 1}
    assert [len(x) for x in seen] == [1, 2]


def test_files_are_written_by_executors(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.pdf", b"%PDF-1"), (2, "b.pdf", None), (3, "../c.pdf", b"x"), (4, "a2.pdf", b"")], "id int, name string, content binary").repartition(3)
    for folder in (str(tmp_path / "out"), f"file://{tmp_path}/out"):
        rows = {r["id"]: r for r in pages.write_files(files, folder).collect()}
        assert rows[1]["path"].endswith("/out/a.pdf") and rows[2]["path"] is None and rows[2]["error"] is None and "not a file name" in rows[3]["error"]
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["a.pdf", "a2.pdf"] and (tmp_path / "out/a.pdf").read_bytes() == b"%PDF-1"


def test_the_splitter_loses_nothing_of_any_document(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    chunks = chunking.chunk_table(d, F.col("text"), F.lit("s"), F.col("doc_id"))
    by = {}
    for r in chunks.collect():
        by.setdefault(int(r["doc_id"]), []).append((r["chunk_index"], r["total_chunks"], r["text"]))
    squeezed, checked = (lambda t: "".join(t.split())), 0
    for r in d.collect():
        mine = sorted(by.get(r["doc_id"], []))
        text = r["text"] or ""
        assert [x[0] for x in mine] == list(range(len(mine))) and all(x[1] == len(mine) for x in mine)
        at = 0
        for _, _, t in mine:
            assert chunking.LEAST <= len(t) <= chunking.SIZE and t == t.strip()
            where = text.find(t, max(0, at - chunking.OVERLAP - chunking.SIZE))  # a piece of the text, in order
            assert where >= 0 and where + len(t) > at - chunking.OVERLAP - chunking.SIZE
            at = max(at, where + len(t))
        whole = squeezed(text)
        # where a passage repeats, its place can't be told; elsewhere the chunks cover the text
        if len(mine) > 1 and "\n#" not in text and not text.startswith("#") and all(whole.find(squeezed(t)) == whole.rfind(squeezed(t)) for _, _, t in mine):
            checked += 1
            covered = 0
            for _, _, t in mine:
                t = squeezed(t)
                k = whole.find(t, max(0, covered - 2 * chunking.SIZE))
                assert k >= 0 and k - covered < chunking.LEAST  # no more than what is too short for a chunk is left out
                covered = max(covered, k + len(t))
            assert len(whole) - covered < chunking.LEAST
    assert checked > 100
