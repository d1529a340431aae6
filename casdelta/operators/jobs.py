"""Job logs, job status and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_delta(logs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, data, next_offset): bytes from an offset on; no log: none, same offset; beyond the end: none, the length."""
    out = requests.join(logs.select("job_id", "content"), "job_id", "left")
    size = F.octet_length("content").cast("long")
    past = F.col("offset") >= size
    data = F.when(size.isNull() | past, F.lit(b"")).otherwise(F.expr("substring(content, int(offset) + 1, 2147483647)"))
    return out.select("request_id", data.alias("data"), F.coalesce(size, F.col("offset")).alias("next_offset"))


def job_status(jobs: DataFrame) -> DataFrame:
    """(job_id, state, code) of jobs (job_id, alive, status): a status row means done, bad codes are -1; else running while alive."""
    code = F.coalesce(F.expr("try_cast(trim(status) AS INT)"), F.lit(-1))
    done = F.col("status").isNotNull()
    running = ~done & F.coalesce("alive", F.lit(False))
    return jobs.select("job_id", F.when(running, "running").otherwise("done").alias("state"), F.when(done, code).when(~running, F.lit(-1)).alias("code"))


def poll(logs: DataFrame, jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, data, next_offset, running, exit_code) of requests (request_id, job_id, offset): one look at a job that is followed.

    The next request goes from next_offset on while running holds. exit_code is null until then, 0 for a job that nothing is known of.
    """
    state = requests.select("request_id", "job_id").join(job_status(jobs), "job_id", "left")
    running = F.coalesce(F.col("state") == "running", F.lit(False))
    ends = state.select("request_id", running.alias("running"), F.when(~running, F.coalesce("code", F.lit(0))).alias("exit_code"))
    return log_delta(logs, requests).join(ends, "request_id")


def trim(jobs: DataFrame, most: int = 64, host: str | None = None) -> DataFrame:
    """Jobs kept: the `most` newest by started_ms, else by dir_mtime_ms, else 0; ties to the larger id; by host if one is named."""
    age = F.coalesce("started_ms", "dir_mtime_ms", F.lit(0))
    if host is None:
        return jobs.orderBy(age.desc(), F.desc("job_id")).limit(most)
    order = Window.partitionBy(host).orderBy(age.desc(), F.desc("job_id"))
    return jobs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
