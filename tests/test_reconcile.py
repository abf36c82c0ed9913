"""Runs that stop between phases and are completed, and versions that readers meet meanwhile."""

import pytest

from lorefield.operators.reconcile import PHASES, Reconciler, page_print
from lorefield.sources import versions as V

PAGES = [("01-a.md", "a", "rank: 1\npaper_count: 2\nmine"), ("02-b.md", "b", "made b"), ("03-b.md", "b", "rank: 9\nby hand"), ("04-c.md", "c", "made c"), ("05-d.md", "d", "kept once"), ("06-x.md", None, "unscoped"), ("07-a.md", "a", "later of a person")]
WANTED = [("a", 2, 5, "02-a.md", "fresh a"), ("b", 1, 3, "01-b.md", "fresh b"), ("e", 3, 1, "03-e.md", "fresh e"), ("f", 4, 0, "04-f.md", "no papers")]


def state(spark, folder):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(PAGES, "path string, type_id string, text string")
    store = spark.createDataFrame([("b", "made b"), ("c", "made c"), ("d", "other")], "type_id string, text string").select("type_id", page_print(F.col("text")).alias("fingerprint"))
    found = Reconciler(spark, folder)
    found.seed(pages, store)
    return found


def wanted(spark):
    return spark.createDataFrame(WANTED, "type_id string, rank int, paper_count int, path string, body string")


def rows(tables):
    return {name: sorted(map(tuple, tables[name].collect()), key=repr) for name in PHASES[2:]}


def test_pages_move_to_their_ranks(spark, tmp_path):
    got = rows(state(spark, f"file://{tmp_path}/s").run(wanted(spark)))
    assert got["pages"] == [("01-b.md", "b", "rank: 1\nby hand"), ("02-a.md", "a", "later of a person"), ("03-e.md", "e", "fresh e")]
    assert [(n, c) for n, c, _ in got["archive"]] == [("01-a.md", 0), ("05-d.md", 0), ("06-x.md", 0)]
    assert [t for t, _ in got["store"]] == ["e"]


@pytest.mark.parametrize("phase", PHASES[1:])
def test_a_stopped_run_is_completed_from_its_own_plan(spark, tmp_path, phase):
    want = rows(state(spark, f"file://{tmp_path}/whole").run(wanted(spark)))
    stopped = state(spark, f"file://{tmp_path}/stopped")
    before = rows({name: stopped.table(name) for name in PHASES[2:]})

    def stop(at):
        if at == phase:
            raise InterruptedError(at)

    with pytest.raises(InterruptedError):
        stopped.run(wanted(spark), before=stop)
    assert rows({name: stopped.table(name) for name in PHASES[2:]}) == before  # readers have the tables as they were
    assert stopped.open_run() is not None
    assert rows(stopped.run(wanted(spark).where("false"))) == want
    assert stopped.open_run() is None


def test_a_run_that_stops_before_its_plan_leaves_nothing(spark, tmp_path):
    found = state(spark, f"file://{tmp_path}/s")

    def stop(at):
        raise InterruptedError(at)

    with pytest.raises(InterruptedError):
        found.run(wanted(spark), before=stop)
    assert found.open_run() is None
    assert rows(found.run(wanted(spark)))["pages"][0][0] == "01-b.md"


def test_runs_follow_one_another(spark, tmp_path):
    found = state(spark, f"file://{tmp_path}/s")
    found.run(wanted(spark))
    got = rows(found.run(wanted(spark).where("type_id = 'e'")))
    assert got["pages"] == [("03-e.md", "e", "fresh e")]
    assert sorted((n, c) for n, c, _ in got["archive"]) == [("01-a.md", 0), ("01-b.md", 0), ("02-a.md", 0), ("05-d.md", 0), ("06-x.md", 0)]
    assert rows(found.run(wanted(spark).where("false")))["pages"] == []


def test_readers_find_the_last_committed_version(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert V.versions(spark, folder) == []
    V.publish(spark.range(1), folder)
    lost = V.claim(spark, folder)  # a writer that never came back, with files of a job that did not commit
    spark.range(9).write.parquet(f"{folder}/v={lost:010d}/part")
    assert V.versions(spark, folder) == [1] and V.read_version(spark, folder).count() == 1
    assert V.publish(spark.range(4), folder) == 3 and V.read_version(spark, folder).count() == 4
