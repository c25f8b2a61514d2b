"""Jobs as an event log: batch views, and the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A file's stages in order.
STAGES = ["queued", "parsing", "sectioning", "extracting", "normalizing", "storing", "comparing", "done", "failed"]


def latest(events: DataFrame) -> DataFrame:
    """events(job_id, seq, stage, ts) -> each job's last stage and its number of events."""
    return events.groupBy("job_id").agg(F.max_by("stage", "seq").alias("stage"), F.count(F.lit(1)).alias("n_events"))


def latest_running(events: DataFrame) -> DataFrame:
    """The running job that began last, and whether there is one."""
    running = events.groupBy("job_id").agg(F.max_by("stage", "seq").alias("stage"), F.min("seq").alias("began")).filter(~F.col("stage").isin("done", "failed"))
    return running.agg(F.max_by("job_id", "began").alias("job_id"), (F.count(F.lit(1)) > 0).alias("any_running"))


def files(events: DataFrame) -> DataFrame:
    """events(job_id, seq, kind, file_no, value, detail) -> each file of each job: (job_id,
    file_no, filename, stage, stage_detail, error, result).

    Kinds: created (value is the file names, comma-separated), stage (with a detail), result
    and error. Files begin as queued; a stage without a detail clears the one before. Events
    of a job that was not created, or of a file that it does not have, change nothing."""
    made = events.filter("kind = 'created'").groupBy("job_id").agg(F.min_by("value", "seq").alias("names"), F.min("seq").alias("began"))
    each = made.select("job_id", "began", F.posexplode(F.split("names", ",")).alias("file_no", "filename"))
    told = events.filter("kind in ('stage', 'result', 'error')").select("job_id", "file_no", "seq", "kind", "value", "detail")
    stage = F.when(F.col("kind") == "result", "done").when(F.col("kind") == "error", "failed").otherwise(F.col("value"))
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col("seq"))).alias(kind)
    known = each.join(told, ["job_id", "file_no"], "left").withColumn("seq", F.when(F.col("seq") > F.col("began"), F.col("seq"))).withColumn("stage", stage)
    now = F.max_by(F.struct("stage", F.when(F.col("kind") == "stage", F.col("detail")).alias("detail")), "seq").alias("now")
    held = known.groupBy("job_id", "file_no", "filename").agg(now, last("error"), last("result"))
    return held.select("job_id", "file_no", "filename", F.coalesce("now.stage", F.lit("queued")).alias("stage"), F.col("now.detail").alias("stage_detail"), "error", "result")


def payloads(events: DataFrame) -> DataFrame:
    """(job_id, payload): a job's state as JSON, with its status (the last of completed and
    failed, else running), the file it is at, its error and its files in order."""
    last = lambda kinds, value: F.max_by(value, F.when(F.col("kind").isin(*kinds) & (F.col("seq") > F.col("began")), F.col("seq")))
    began = events.filter("kind = 'created'").groupBy("job_id").agg(F.min("seq").alias("began"))
    told = events.join(began, "job_id").groupBy("job_id").agg(
        F.coalesce(last(["completed", "failed"], F.col("kind")), F.lit("running")).alias("status"),
        F.coalesce(last(["current"], F.col("file_no")), F.lit(0)).alias("current_file_index"),
        last(["failed"], F.col("value")).alias("error"),
    )
    fields = F.struct("filename", "stage", "stage_detail", "error", "result")
    listed = files(events).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_no", fields.alias("f")))), lambda x: x["f"]).alias("files"))
    both = told.join(listed, "job_id")
    whole = F.struct("job_id", "status", "current_file_index", F.size("files").alias("total_files"), "error", "files")
    return both.select("job_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload"))


def totals(done: DataFrame) -> DataFrame:
    """done(error, n_facts, n_relationships), a row for each file -> what a batch did."""
    sums = [F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("n_facts", "n_relationships")]
    return done.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"), *sums)


def stage_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and stage; works on a stream as on a table (an extra)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", window).alias("w"), "stage").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "stage", "n")
