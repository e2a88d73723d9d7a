"""A queue of jobs as a stream of request files: each is run once and its status written; a query is polled until it ends."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATES = ("queued", "processing", "done", "failed")


def run_queue(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], history: str | None = None) -> StreamingQuery:
    """Runs `work` on each batch of requests (job_id, payload) dropped into a folder, and appends (job_id, status, message) to another.

    A batch that fails is written as failed, job by job; the checkpoint keeps a request from running again once its status is written. With
    `history`, a folder, every state that a job takes is written there: queued when it is read, processing before its work begins, then its end.
    """
    requests = spark.readStream.schema("job_id string, payload string").json(inbox)

    def each(batch: DataFrame, batch_id: int) -> None:
        jobs = batch.groupBy("job_id").agg(F.first("payload").alias("payload"))

        def note(state: str, of: DataFrame) -> None:
            if history:
                seen = of.select("job_id", F.lit(state).alias("status"), F.current_timestamp().alias("at"))
                seen.write.mode("overwrite").json(f"{history.rstrip('/')}/batch={batch_id}/step={STATES.index(state)}")

        note("queued", jobs)
        note("processing", jobs)
        try:
            out, state = work(jobs).select("job_id", F.lit("done").alias("status"), F.col("message").cast("string").alias("message")), "done"
            out.write.mode("overwrite").json(f"{outbox.rstrip('/')}/batch={batch_id}")
        except Exception as e:  # noqa: BLE001  the queue goes on
            out, state = jobs.select("job_id", F.lit("failed").alias("status"), F.lit(str(e)[:200]).alias("message")), "failed"
            out.write.mode("overwrite").json(f"{outbox.rstrip('/')}/batch={batch_id}")
        note(state, jobs)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(spark: SparkSession, history: str) -> DataFrame:
    """`job_id`, `status` (the last one), `steps` (all, in order) of the jobs in a queue's history."""
    seen = spark.read.schema("job_id string, status string, batch long, step int").json(history)
    steps = F.array_sort(F.collect_list(F.struct("batch", "step", "status")))
    return seen.groupBy("job_id").agg(F.max_by("status", F.struct("batch", "step")).alias("status"), F.transform(steps, lambda x: x["status"]).alias("steps"))


def poll(query: StreamingQuery, every: float = 1.5, most: float = 600.0) -> str:
    """Asks for a query's state until it ends: `done`, `failed`, or `processing` if the time is over."""
    until = time.monotonic() + most
    while query.isActive and time.monotonic() < until:
        time.sleep(every)
    if query.isActive:
        return "processing"
    return "failed" if query.exception() else "done"
