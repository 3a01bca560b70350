import datetime as dt

from pyspark.sql import functions as F

from plotmark import schemas
from plotmark.operators import audit, status

T = dt.datetime(2024, 1, 1)
FIELDS = [f.split(" ")[0] for f in schemas.JOB_EVENT.split(", ")]


def event(task, seq, state, **more):
    row = dict.fromkeys(FIELDS) | {"task_id": task, "seq": seq, "address_id": "a", "state": state, "event_ts": T + dt.timedelta(minutes=seq), "embedding_delta": 0} | more
    return tuple(row[f] for f in FIELDS)


def test_progress_adds_up_and_done_clears_errors(spark):
    events = [event("t", 1, "pending"), event("t", 2, "chunking", chunk_count=7), event("t", 3, "embedding", embedding_delta=4), event("t", 4, "failed", error_type="E", failed_step="embed"), event("t", 5, "embedding", embedding_delta=4), event("t", 6, "done")]
    df = spark.createDataFrame(events, schemas.JOB_EVENT)
    r = status.job_status(df).first()
    assert (r.state, r.chunk_count, r.embedding_count, r.error_type, r.failed_step) == ("done", 7, 8, None, None)
    assert r.created_at == T + dt.timedelta(minutes=1) and r.finished_at == T + dt.timedelta(minutes=6)
    early = status.job_status(df.filter("seq < 5")).first()
    assert (early.error_type, early.finished_at) == ("E", T + dt.timedelta(minutes=4))
    assert status.job_status(df.filter("task_id = 'none'")).count() == 0


def test_failures(spark):
    rows = [("a", "RateLimitError", "m" * 3000, 4), ("b", "RateLimitError", None, 5), ("c", "ValueError", "x", 0), ("d", None, "x", 0), ("e", "TimeoutError", "x", 1)]
    got = {r.task_id: r for r in status.failure_outcome(spark.createDataFrame(rows, "task_id string, error_type string, error_message string, attempts int")).collect()}
    assert {k: r.state for k, r in got.items()} == {"a": "pending", "b": "failed", "c": "failed", "d": "failed", "e": "pending"}
    assert len(got["a"].error_message) == 2000


def test_stuck(spark):
    old, now = T - dt.timedelta(minutes=11), F.lit(T)
    rows = [("a", "pending", old, None), ("b", "embedding", old, T - dt.timedelta(seconds=1)), ("c", "embedding", old, T + dt.timedelta(seconds=1)), ("d", "done", old, None), ("e", "pending", T - dt.timedelta(minutes=9), None)]
    df = spark.createDataFrame(rows, "task_id string, state string, created_at timestamp, lease_until timestamp")
    assert {r.task_id for r in status.stuck_jobs(df, now).collect()} == {"a", "b"}


def test_costs(spark):
    rows = [("a", "m", 10, 0.5), ("a", "m", 5, 0.25), ("b", "m", 1, 0.0)]
    df = spark.createDataFrame(rows, "address_id string, model_id string, tokens_embedded long, c double").withColumn("cost_usd", F.col("c").cast("decimal(12,6)"))
    assert {(r.address_id, r.tokens_embedded, float(r.cost_usd)) for r in status.ingest_cost(df, "address_id", "model_id").collect()} == {("a", 15, 0.75), ("b", 1, 0.0)}


def test_a_sound_index_passes_the_audit(spark):
    docs = spark.createDataFrame([("d", "a", "u", 1)], "document_id string, address_id string, upload_id string, live_version int")
    chunks = spark.createDataFrame([("c0", "d", "a", 1, 0, "x"), ("c1", "d", "a", 1, 1, "y")], "chunk_id string, document_id string, address_id string, doc_version int, ordinal int, text string")
    vectors = spark.createDataFrame([("c0", "a", "m", 1, [1.0])], schemas.EMBEDDING)
    models = spark.createDataFrame([("m", 1)], "model_id string, dim int")
    jobs = spark.createDataFrame([("t", "done")], "task_id string, state string")
    assert audit.duplicate_keys(docs, chunks, vectors).count() == audit.orphans(docs, docs, chunks, vectors).count() == audit.domain_violations(jobs, docs, chunks, vectors, models).count() == 0
    broken = audit.domain_violations(jobs.withColumn("state", F.lit("odd")), docs, chunks.filter("ordinal = 1").withColumn("text", F.lit(None).cast("string")), vectors.withColumn("dim", F.lit(2)), models)
    assert sorted(r.rule for r in broken.collect()) == ["gap in ordinals", "missing value", "unknown state", "wrong dimension"]
    shared = docs.union(spark.createDataFrame([("e", "a", "u/", 1), ("f", "a", "u_", 1)], docs.schema))
    assert {r.rule for r in audit.orphans(docs, shared, chunks, vectors).collect()} == {"shared storage path"}


def test_percentiles_of_a_large_group_are_exact(spark):
    n = 200_000
    log = spark.range(n).select(F.lit("a").alias("address_id"), F.lit("m").alias("model_id"), (F.col("id") * 7919 % 200_003).cast("int").alias("latency_ms"), F.lit(2).alias("candidates_examined"), F.lit(1).alias("chunks_returned"), F.lit(0.5).cast("decimal(12,6)").alias("cost_usd"))
    unknown = log.limit(3).withColumn("latency_ms", F.lit(None).cast("int"))
    other = log.limit(2).withColumns({"address_id": F.lit("b"), "latency_ms": F.lit(None).cast("int")})
    got = {r.address_id: r for r in status.query_metrics(log.unionByName(unknown).unionByName(other)).collect()}
    values = sorted(i * 7919 % 200_003 for i in range(n))
    a, b = got["a"], got["b"]
    assert a.p95_latency_ms == values[n * 95 // 100 - 1] and abs(a.avg_latency_ms - sum(values) / n) < 1e-6
    assert (a.queries, a.candidates_examined, a.chunks_returned, float(a.cost_usd)) == (n + 3, 2 * n + 6, n + 3, n / 2 + 1.5)
    assert (b.queries, b.avg_latency_ms, b.p95_latency_ms) == (2, None, None)
