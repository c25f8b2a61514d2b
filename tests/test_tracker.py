import random

import pytest

from claimgraph.streaming import jobs, tracker

SCHEMA = "job_id string, seq long, kind string, file_no int, value string, detail string"


def run(spark, rows, path, parts):
    """Through a stream of so many batches."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = tracker.track(stream, f"{path}/out", f"{path}/check")
    query.awaitTermination()
    return query, {tuple(r) for r in tracker.current(spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")).collect()}


def log(rng, jobs_, n):
    rows = []
    for j in range(jobs_):
        rows.append((f"j{j}", 3, "created", None, ",".join(f"f{k}" for k in range(1 + j % 3)), None))
        for seq in range(4 if j % 4 else 1, n):
            kind = rng.choice(["stage", "stage", "result", "error", "current", "completed", "noise"])
            rows.append((f"j{j}", seq, kind, rng.choice([None, -1, 0, 1, 2, 9]), rng.choice(["parsing", "storing", None]), rng.choice([None, "1/2"])))
    return [*rows, ("never made", 5, "stage", 0, "parsing", None), (None, 5, "stage", 0, "parsing", None)]


@pytest.mark.parametrize("order", ["sorted", "shuffled"])
def test_stream_ends_with_the_table_s_files(spark, tmp_path, order):
    """Events in any order, told twice, of jobs made later or never, of files that are not there."""
    rng = random.Random(order)
    rows = log(rng, 7, 14)
    rows += rng.sample(rows, 20)
    if order == "shuffled":
        rng.shuffle(rows)
    query, got = run(spark, rows, tmp_path, 3)
    held = spark.createDataFrame(rows, SCHEMA).filter("job_id is not null")
    assert got == {tuple(r) for r in jobs.files(held).collect()} and len(got) > 10
    assert sum(1 for p in query.recentProgress if p.numInputRows) == 3
    operator = query.lastProgress.stateOperators[0]
    assert operator.numRowsTotal <= 7 * 4 + 2  # a value and its files for each job, what came early for one never made


def test_events_without_effect_give_no_rows(spark, tmp_path):
    rows = [("a", 1, "created", None, "x", None), ("a", 2, "stage", 0, "parsing", None), ("a", 3, "noise", 0, None, None), ("a", 4, "stage", 7, "parsing", None)]
    _, got = run(spark, rows, tmp_path, 4)
    kept = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out")
    assert got == {("a", 0, "x", "parsing", None, None, None)} and kept.count() == 2


def test_a_new_job_asks_for_its_state_once():
    """What is not there yet is not asked for: no file of a job that the state does not know."""
    asked = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            return lambda *a: asked.append((self.name, call)) or ([] if (self.name, call) == ("early", "get") else None)

    import pandas as pd

    worker = tracker.FileTracker()
    worker.job, worker.files, worker.early = State("job"), State("files"), State("early")
    rows = pd.DataFrame([(1, "created", None, "x,y", None), (2, "stage", 0, "parsing", None), (3, "result", 1, "r", None)], columns=["seq", "kind", "file_no", "value", "detail"])
    out = pd.concat(worker.handleInputRows(("j",), iter([rows]), None))
    assert out.stage.tolist() == ["parsing", "done"]
    assert [a for a in asked if a[1] not in ("updateValue", "update", "clear")] == [("job", "get"), ("early", "get")]
