"""Job status, failures, address status, stuck jobs, query metrics and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotmark.operators.lifecycle import missing_embeddings
from plotmark.schemas import IN_FLIGHT

#: Names of errors that are worth another try.
RETRYABLE = (
    "TimeoutError",
    "ConnectionError",
    "RateLimitError",
    "APITimeoutError",
    "APIConnectionError",
    "InternalServerError",
    "APIError",
    "EndpointConnectionError",
    "ConnectTimeoutError",
    "ReadTimeoutError",
    "ConnectionClosedError",
    "BrokenPipeError",
    "ConnectionAbortedError",
    "ConnectionRefusedError",
    "ConnectionResetError",
)
MAX_ATTEMPTS, MESSAGE = 5, 2000


def job_status(events: DataFrame) -> DataFrame:
    """The state of each task by its events: state, errors and model of the last one, the last known chunk count,
    embeddings, tokens and cost added up; done and skipped tasks have no errors and an end. Works on streams too."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    known = F.max_by("chunk_count", F.when(F.col("chunk_count").isNotNull(), F.col("seq")))
    rolled = events.groupBy("task_id").agg(
        last("address_id"),
        last("document_id"),
        last("model_id"),
        last("job_type"),
        last("state"),
        known.alias("chunk_count"),
        F.coalesce(F.sum("embedding_delta"), F.lit(0)).alias("embedding_count"),
        F.coalesce(F.sum("tokens_delta"), F.lit(0)).alias("tokens_embedded"),
        F.coalesce(F.sum("cost_delta"), F.lit(0)).cast("decimal(12,6)").alias("cost_usd"),
        F.coalesce(F.max("attempts"), F.lit(0)).alias("attempts"),
        last("failed_step"),
        last("error_type"),
        last("error_message"),
        last("lease_until"),
        F.min("event_ts").alias("created_at"),
        F.max_by("event_ts", "seq").alias("last_ts"),
    )
    ended, fine = F.col("state").isin("done", "skipped", "failed"), F.col("state").isin("done", "skipped")
    for c in ("failed_step", "error_type", "error_message"):
        rolled = rolled.withColumn(c, F.when(~fine, F.col(c)))
    return rolled.withColumn("finished_at", F.when(ended, F.col("last_ts"))).drop("last_ts")


def failure_outcome(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(task_id, error_type, error_message, attempts) with retryable, state and the message cut to its stored length."""
    retry = F.coalesce(F.col("error_type").isin(*RETRYABLE), F.lit(False))
    return failures.withColumns(
        {
            "retryable": retry,
            "state": F.when(retry & (F.col("attempts") < max_attempts), "pending").otherwise("failed"),
            "error_message": F.substring("error_message", 1, MESSAGE),
        }
    )


def missing_by_address(chunks: DataFrame, documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(address_id, missing): live chunks without an embedding under the active model (all, if it has none at all)."""
    return missing_embeddings(chunks, documents, embeddings).groupBy("address_id").agg(F.count(F.lit(1)).alias("missing"))


def address_status(addresses: DataFrame, documents: DataFrame, jobs: DataFrame, missing: DataFrame, with_jobs: int = 0) -> DataFrame:
    """Per address: documents, jobs on their way, failed jobs, missing embeddings, and whether all is indexed. With
    ``with_jobs`` also so many of its newest jobs, newest first."""
    docs = documents.groupBy("address_id").agg(F.count(F.lit(1)).alias("document_count"))
    per = jobs.groupBy("address_id").agg(F.count_if(F.col("state").isin(*IN_FLIGHT)).alias("in_flight"), F.count_if(F.col("state") == "failed").alias("failed"))
    out = addresses.select("address_id").join(docs, "address_id", "left").join(per, "address_id", "left").join(missing, "address_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("address_id", n("document_count").alias("document_count"), n("in_flight").alias("in_flight"), n("failed").alias("failed"), n("missing").alias("missing_embeddings"))
    out = out.withColumns({"has_documents": F.col("document_count") > 0, "fully_indexed": (F.col("in_flight") == 0) & (F.col("failed") == 0) & (F.col("missing_embeddings") == 0)})
    if not with_jobs:
        return out
    newest = Window.partitionBy("address_id").orderBy(F.desc("created_at"), "task_id")
    some = jobs.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= with_jobs)
    listed = some.groupBy("address_id").agg(F.array_sort(F.collect_list(F.struct("place", "task_id", "state", "created_at"))).alias("jobs"))
    return out.join(listed, "address_id", "left")


def stuck_jobs(jobs: DataFrame, as_of: Column, stuck_after: str = "INTERVAL 10 MINUTES") -> DataFrame:
    """Jobs before their end without a running lease that began longer than ``stuck_after`` before ``as_of``."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") < as_of)
    return jobs.filter(F.col("state").isin(*IN_FLIGHT) & free & (F.col("created_at") < as_of - F.expr(stuck_after)))


def query_metrics(log: DataFrame) -> DataFrame:
    """Per address and model: queries, latency (mean to 6 places, and exact 95th percentile: the least that 95 of 100 don't exceed),
    candidates, results and cost.

    Latencies are counted by value first, in partial aggregates, so that neither a group's rows nor its values are held at once."""
    keys = ("address_id", "model_id")
    sums = ("candidates_examined", "chunks_returned", "cost_usd")
    valued = log.groupBy(*keys, "latency_ms").agg(F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("known"), *[F.sum(c).alias(c) for c in sums])
    group = Window.partitionBy(*keys)
    so_far = F.sum("known").over(group.orderBy(F.asc_nulls_last("latency_ms")).rowsBetween(Window.unboundedPreceding, 0))
    valued = valued.withColumns({"so_far": so_far, "total": F.sum("known").over(group)})
    mean = F.sum(F.col("latency_ms").cast("long") * F.col("known")) / F.sum("known")
    return valued.groupBy(*keys).agg(
        F.sum("n").alias("queries"),
        (F.round(mean * 1e6) / 1e6).alias("avg_latency_ms"),
        F.min(F.when(F.col("so_far") * 100 >= F.col("total") * 95, F.col("latency_ms"))).alias("p95_latency_ms"),
        *[F.sum(c).alias(c) for c in sums[:2]],
        F.sum("cost_usd").cast("decimal(12,6)").alias("cost_usd"),
    )


def ingest_cost(jobs: DataFrame, *keys: str) -> DataFrame:
    """Tokens and cost by ``keys``, such as address_id and model_id."""
    return jobs.groupBy(*keys).agg(F.sum("tokens_embedded").alias("tokens_embedded"), F.sum("cost_usd").cast("decimal(12,6)").alias("cost_usd"))
