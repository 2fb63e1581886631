import json
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.sources import listing


def pages(folder, ids, each=3, titles=lambda i: f"t{i}"):
    """Ids, newest first, as page files."""
    folder.mkdir(exist_ok=True)
    for old in folder.iterdir():
        old.unlink()
    for n in range(0, len(ids), each):
        (folder / f"page_{n // each + 1}.json").write_text(json.dumps([{"id": i, "title": titles(i)} for i in ids[n : n + each]]))
    return str(folder)


class Counted(listing.Listing):
    def __init__(self, ids, each, pages=listing.PAGES):
        self.asked = []
        super().__init__(lambda n: self.asked.append(n) or json.dumps([{"id": i} for i in ids[(n - 1) * each : n * each]]), pages)


def test_page_ranges_hold_what_a_loop_over_pages_finds():
    rng = random.Random(1)
    for _ in range(60):
        ids = sorted(rng.sample(range(1000), rng.randint(0, 200)), reverse=True)
        each, low = rng.randint(1, 7), rng.choice([None, -1, 0, 300, 998, 2000])
        found = Counted(ids, each, rng.randint(1, 5))
        parts = found.ranges(low)
        rows = [r[0] for p in parts for r in found.rows(p)]
        assert rows == [i for i in ids if low is None or i > low]
        assert [x for p in parts for x in range(p.first, p.last + 1)] == list(range(1, parts[-1].last + 1))
        assert all(p.last - p.first < found.pages for p in parts)


def test_planning_asks_for_few_pages():
    found = Counted(list(range(100_000, 0, -1)), 10)
    parts = found.ranges(40_000)
    assert parts[-1].last == 6001 and len(found.asked) < 40 and len(parts) == 301
    assert Counted([], 10).newest() is None


def test_batch_pushes_the_watermark_down(spark, tmp_path):
    listing.register(spark)
    ids = list(range(90, 0, -1))
    folder = pages(tmp_path / "in", ids)
    load = lambda: spark.read.format("listing").option("folder", folder).option("pages_per_task", 4).load()
    assert sorted(r["id"] for r in load().collect()) == sorted(ids) and load().rdd.getNumPartitions() == 8
    some = load().filter("id > 70")
    assert sorted(r["id"] for r in some.select("id").collect()) == list(range(71, 91))
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [GreaterThan(id,70)]" in plan and "> 70" not in plan  # the source's own work, not done again
    assert some.rdd.getNumPartitions() == 2  # seven pages, four a task
    assert sorted(r["id"] for r in load().filter("id >= 88 AND title <> 't89'").collect()) == [88, 90]


def test_items_without_a_proper_id_and_broken_pages(spark, tmp_path):
    listing.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "page_1.json").write_text(json.dumps([{"id": 9, "title": "n"}, {"title": "lost"}, {"id": "x"}, 5, {"id": "8", "title": {"tr": "ö"}}]))
    (folder / "page_2.json").write_text(json.dumps([{"title": "none here"}]))
    (folder / "page_3.json").write_text(json.dumps([{"id": 7}]))
    (folder / "page_4.json").write_text("{broken")
    (folder / "page_5.json").write_text(json.dumps([{"id": 1}]))
    rows = {r["id"]: r["title"] for r in spark.read.format("listing").option("folder", str(folder)).load().collect()}
    assert rows == {9: "n", 8: '{"tr": "ö"}', 7: None}
    assert spark.read.format("listing").option("folder", str(tmp_path / "nothing")).load().count() == 0


def test_stream_and_batch_give_equal_rows_and_go_on_after_a_restart(spark, tmp_path):
    listing.register(spark)
    folder = pages(tmp_path / "in", list(range(40, 0, -1)))

    def run():
        q = spark.readStream.format("listing").option("folder", folder).option("pages_per_task", 3).load()
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    batch = lambda: sorted(tuple(r) for r in spark.read.format("listing").option("folder", folder).load().collect())
    streamed = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run()
    assert streamed() == batch() and len(batch()) == 40
    pages(tmp_path / "in", list(range(55, 0, -1)))  # every item has moved to another page
    run()
    run()
    assert streamed() == batch() and len(batch()) == 55


@pytest.mark.parametrize("since", [0, 30])
def test_a_stream_may_begin_after_an_id(spark, tmp_path, since):
    listing.register(spark)
    folder = pages(tmp_path / "in", list(range(40, 0, -1)))
    q = spark.readStream.format("listing").option("folder", folder).option("since", since).load().writeStream.format("memory").queryName(f"since{since}").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table(f"since{since}").agg(F.min("id"), F.count("*")).first() == (since + 1, 40 - since)
