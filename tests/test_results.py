"""Result stores: batches that repeat, fail or stop half way, and columns that come later."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackline.sources.results import ResultStore, ResumableRun, batched, merged_schema

SUMMARY = StructType().add("model", "string").add("seed", "integer").add("value", "double")


@pytest.fixture
def grid(spark):
    return spark.createDataFrame([(m, s) for m in ("lw", "qis", None) for s in range(5)], "model string, seed int")


def work(own):
    return {"summary": own.select("model", "seed", (F.col("seed") * 1.5).alias("value")), "series": own.select("model", "seed", F.explode(F.sequence(F.lit(1), F.col("seed") + 1)).alias("t"))}


def rows(store, table):
    return sorted((tuple(r) for r in store.read(table).drop("batch").collect()), key=str)


def test_a_run_goes_on_where_it_stopped(spark, grid, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/a", {"summary": SUMMARY})
    assert store.read("summary").collect() == [] and store.schema("nothing") is None
    run = ResumableRun(store, grid, ["model", "seed"], 4)
    assert run.pending().count() == 15
    assert run.run(work, most=2) == [0, 1]
    # Another process: all it knows is the folder.
    later = ResumableRun(ResultStore(spark, f"file://{tmp_path}/a", {"summary": SUMMARY}), grid.orderBy(F.rand(1)), ["model", "seed"], 4)
    assert later.pending().count() == 7
    later.run_batch(1, work)
    assert later.run(work) == [2, 3] and later.run(work) == [] and later.pending().count() == 0
    assert rows(store, "summary") == sorted(((m, s, s * 1.5) for m in ("lw", "qis", None) for s in range(5)), key=str)
    assert store.read("series").count() == 3 * 15
    assert {r.batch: dict(r.rows)["summary"] for r in store.commits().collect()} == {0: 4, 1: 4, 2: 4, 3: 3}


def test_rows_without_their_commit_do_not_exist(spark, grid, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/b", {"summary": SUMMARY})
    run = ResumableRun(store, grid, ["model", "seed"], 5)
    run.run(work, most=1)
    # What a driver leaves that is lost between the tables and the log.
    spark.createDataFrame([("half", 1, 0.0)], SUMMARY).write.parquet(f"{tmp_path}/b/summary/batch=1")
    assert store.read("summary").count() == 5 and store.read("summary").filter("model = 'half'").isEmpty()
    assert run.run(work) == [1, 2]
    assert store.read("summary").count() == 15 and store.read("summary").filter("model = 'half'").isEmpty()


def test_a_batch_that_fails_is_logged_and_tried_again(spark, grid, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/c", {"summary": SUMMARY})
    run = ResumableRun(store, grid, ["model", "seed"], 8)

    def fails(own):
        if own.filter("model = 'qis'").isEmpty():
            return work(own)
        raise RuntimeError("no covariance" + "!" * 400)

    def breaks_in_its_tasks(own):
        return {"summary": own.select("model", "seed", F.when(F.col("seed") >= 0, F.raise_error(F.lit("bad row"))).cast("double").alias("value"))}

    assert run.run(fails) == [0, 1]
    log = store.read("run_log").collect()
    failed = [r for r in log if r.status == "error"]
    assert failed and all(len(r.error) == 250 and r.error.startswith("no covariance") for r in failed)
    assert len(log) == 15
    run.run(breaks_in_its_tasks, most=1)
    assert any("bad row" in r.error for r in store.read("run_log").filter("status = 'error'").collect())
    run.run(work)
    assert store.read("run_log").filter("status <> 'success'").isEmpty() and len(rows(store, "summary")) == 15


def test_columns_may_come_later_and_types_are_kept(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/d", {"summary": SUMMARY})
    store.commit(0, {"summary": spark.createDataFrame([("lw", 1, 2.0)], SUMMARY)})
    store.commit(1, {"summary": spark.createDataFrame([("lw", 2, 3, "new")], "model string, seed int, value int, note string")})
    store.commit(2, {"summary": spark.createDataFrame([("qis",)], "model string")})
    assert store.read("summary").columns == ["model", "seed", "value", "note", "batch"]
    assert rows(store, "summary") == sorted([("lw", 1, 2.0, None), ("lw", 2, 3.0, "new"), ("qis", None, None, None)], key=str)
    with pytest.raises(TypeError, match="seed of summary is int, not string"):
        store.commit(3, {"summary": spark.createDataFrame([("lw", "x")], "model string, seed string")})
    assert store.commits().count() == 3 and store.read("summary").count() == 3
    again = ResultStore(spark, f"file://{tmp_path}/d", {"summary": StructType().add("model", "string").add("duration", "double"), "log": SUMMARY})
    assert again.schema("summary").names == ["model", "seed", "value", "note", "duration"] and again.read("log").collect() == []
    assert merged_schema(SUMMARY, SUMMARY) == SUMMARY


def test_batches_follow_from_the_grid_alone(spark, grid):
    one = {(r.model, r.seed): r.batch for r in batched(grid, ["model", "seed"], 4).collect()}
    other = {(r.model, r.seed): r.batch for r in batched(grid.union(grid).repartition(5), ["model", "seed"], 4).collect()}
    assert one == other and sorted(set(one.values())) == [0, 1, 2, 3]
