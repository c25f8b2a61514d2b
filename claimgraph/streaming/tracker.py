"""Job progress as a stream with keyed state: the state of a job's files follows its events.

A job's state is a value (when it was created, its status), a map of its files, and a list of what
was told of it before it was known to exist. Events may come in any order and in any batches: each
field keeps the number of the event that set it, so that an earlier one that comes late, or one that
comes twice, changes nothing. Rows go out for the files that a batch changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_JOB = "began long, names string, status string, status_seq long"
_FILE = "stage string, detail string, stage_seq long, error string, error_seq long, result string, result_seq long"
_TOLD = "seq long, kind string, file_no int, value string, detail string"
_NEVER = -(1 << 62)


def _text(value) -> str | None:
    return None if value is None or value != value else str(value)


class FileTracker(StatefulProcessor):
    """Of events (job_id, seq, kind, file_no, value, detail) as streaming.jobs.files reads them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", _JOB)
        self.files = handle.getMapState("files", "file_no int", _FILE)
        self.early = handle.getListState("early", _TOLD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = [(int(r.seq), r.kind, None if pd.isna(r.file_no) else int(r.file_no), _text(r.value), _text(r.detail)) for part in rows for r in part.itertuples(index=False)]
        job = self.job.get()  # each call asks another process: no more of them than the events need
        created = [t for t in told if t[1] == "created"] + ([(job[0], "created", None, job[1], None)] if job else [])
        if not created:
            if told:
                self.early.appendList(told)
            return
        if not job:
            told += [tuple(t) for t in self.early.get()]
            self.early.clear()
        began, _, _, names, _ = min(created, key=lambda t: t[0])
        status, status_seq = (job[2], job[3]) if job else ("running", _NEVER)
        names_now = names.split(",")
        held, changed = {}, set() if job else set(range(len(names_now)))
        for seq, kind, no, value, detail in sorted(told, key=lambda t: t[0]):
            if seq <= began:
                continue
            if kind in ("completed", "failed") and seq > status_seq:
                status, status_seq = kind, seq
            if kind not in ("stage", "result", "error") or no is None or not 0 <= no < len(names_now):
                continue
            if no not in held:
                # a job that was not known has no files yet
                held[no] = list((self.files.getValue((no,)) if job else None) or ["queued", None, _NEVER, None, _NEVER, None, _NEVER])
            f = held[no]
            if seq > f[2]:
                f[0], f[1], f[2] = {"result": "done", "error": "failed"}.get(kind, value), detail if kind == "stage" else None, seq
                changed.add(no)
            place = {"error": 3, "result": 5}.get(kind)
            if place and seq > f[place + 1]:
                f[place], f[place + 1] = value, seq
                changed.add(no)
        for no in changed & set(held):
            self.files.updateValue((no,), tuple(held[no]))
        if not job or (status, status_seq) != (job[2], job[3]):
            self.job.update((began, names, status, status_seq))
        out = [(key[0], no, names_now[no], f[0] or "queued", f[1], f[3], f[5], max(f[2], f[4], f[6])) for no in sorted(changed) for f in [held.get(no, ["queued", None, _NEVER, None, _NEVER, None, _NEVER])]]
        if out:
            yield pd.DataFrame(out, columns=["job_id", "file_no", "filename", "stage", "stage_detail", "error", "result", "seq"])

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """events, a stream (job_id, seq, kind, file_no, value, detail) -> the files that each
    batch changed: (job_id, file_no, filename, stage, stage_detail, error, result, seq), with
    the number of the last event that told of the file. Null job ids take no part."""
    kind = events.schema["job_id"].dataType.simpleString()
    schema = f"job_id {kind}, file_no int, filename string, stage string, stage_detail string, error string, result string, seq long"
    told = events.filter("job_id is not null and seq is not null").select("job_id", "seq", "kind", "file_no", "value", "detail")
    return told.groupBy("job_id").transformWithStateInPandas(statefulProcessor=FileTracker(), outputStructType=schema, outputMode="Update", timeMode="None")


def track(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the changes of each batch in the folder out, a part for each batch, which a batch
    that runs again replaces."""
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the query keeps what holds when it begins
    try:
        return changes(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def current(kept: DataFrame) -> DataFrame:
    """Of kept changes the last of each file, as streaming.jobs.files gives them."""
    last = F.row_number().over(W.partitionBy("job_id", "file_no").orderBy(F.col("batch").desc()))
    return kept.withColumn("_last", last).filter("_last = 1").select("job_id", "file_no", "filename", "stage", "stage_detail", "error", "result")
