"""The given tables as uploads, documents, chunks, queries, jobs and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmark.functions.text import key_id
from plotmark.operators import chunking, segments

SIZE, OVERLAP = 50, 10
MODEL, DIM = "hash:feature-64", 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, where its files have fewer row groups than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a text upload of its source; its lines are paragraphs."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return d.select(
        F.col("source").alias("address_id"),
        F.col("doc_id").cast("string").alias("upload_id"),
        F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("content_type"),
        F.lit(None).cast("string").alias("display_name"),
        body.cast("binary").alias("data"),
        F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("upload_ts"),
        "doc_id",
        body.alias("body"),
    )


def later_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two later rounds of all documents: of every ten one is changed, one without an upload id, the others the same; a day
    later half of the changed ones change again and the others come unchanged."""
    u = uploads(spark, sf_dir)
    kind = F.col("doc_id") % 10
    again = F.when(F.col("doc_id") % 20 == 0, " revised again").when(kind == 0, " revised").otherwise("")
    first = u.withColumn("body", F.concat("body", F.when(kind == 0, " revised").otherwise("")))
    second = u.withColumns({"body": F.concat("body", again), "upload_ts": F.col("upload_ts") + F.expr("INTERVAL 1 DAY")})
    both = first.unionByName(second)
    return both.withColumns({"data": F.col("body").cast("binary"), "upload_id": F.when(kind != 2, F.col("upload_id"))})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads as live documents of version 1."""
    u = uploads(spark, sf_dir)
    return u.select(
        key_id(F.col("address_id"), F.col("upload_id")).alias("document_id"),
        "address_id",
        "upload_id",
        "content_type",
        F.sha2("data", 256).alias("content_hash"),
        F.concat(F.lit("store/address="), "address_id", F.lit("/doc="), "upload_id", F.lit("/original")).alias("storage_ref"),
        F.col("filename").alias("original_name"),
        F.lit(1).alias("live_version"),
        F.col("upload_ts").alias("ingest_ts"),
    )


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uploads(spark, sf_dir)
    return u.select(key_id(F.col("address_id"), F.col("upload_id")).alias("document_id"), "address_id", F.lit(1).alias("doc_version"), segments.paragraph_segments(segments.decode_bytes(F.col("data"))).alias("segments"), "doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(segmented(spark, sf_dir), SIZE, OVERLAP)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of several pages with four turns each."""
    c = table(spark, sf_dir, "conversations")
    own = F.struct((F.floor(F.col("turn") / 4) + 1).cast("int").alias("page_number"), (F.col("turn") % 4).cast("int").alias("paragraph_index"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", own.alias("segment"))))
    rows = c.groupBy("conv_id").agg(F.transform(ordered, lambda s: s["segment"]).alias("segments"))
    return rows.select(F.concat(F.lit("conv-"), "conv_id").alias("document_id"), F.concat(F.lit("addr-"), F.col("conv_id") % 5).alias("address_id"), F.lit(1).alias("doc_version"), "segments")


def queries(spark: SparkSession, sf_dir: str, words: int = 2) -> DataFrame:
    """Benchmark items as queries of an address: their first words, or all of them where ``words`` is 0."""
    b = table(spark, sf_dir, "benchmark")
    text = F.array_join(F.slice(F.split("text", " "), 1, words), " ") if words else F.col("text")
    return b.select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("address_id"), text.alias("query_text"), F.lit(None).cast("int").alias("k"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("addr-"), "label").alias("address_id"), "embedding", "vec_id")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).filter("vec_id % 50 = 0")
    return v.select(F.concat(F.lit("q"), "chunk_id").alias("query_id"), "address_id", F.lit(3).alias("k"), F.col("embedding").alias("vector"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the progress of one job for each user."""
    e = table(spark, sf_dir, "events")
    state = F.create_map(*[F.lit(x) for x in ("signup", "pending", "view", "extracting", "click", "embedding", "purchase", "done", "error", "failed")])
    k = F.get_json_object("props", "$.k").cast("int")
    error = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("t"), "user_id").alias("task_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("d"), "user_id").alias("document_id"),
        F.concat(F.lit("addr-"), F.col("user_id") % 20).alias("address_id"),
        F.concat(F.lit("hash:feature-"), F.when(F.col("user_id") % 2 == 0, 64).otherwise(128)).alias("model_id"),
        F.when(F.col("user_id") % 7 == 0, "rebuild").otherwise("ingest").alias("job_type"),
        F.try_element_at(state, F.col("event_type")).alias("state"),
        F.when(F.col("event_type") == "view", k).alias("chunk_count"),
        F.when(F.col("event_type") == "click", k).otherwise(0).alias("embedding_delta"),
        F.when(F.col("event_type") == "click", k * 10).otherwise(0).cast("long").alias("tokens_delta"),
        F.when(F.col("event_type") == "click", F.col("value") / 100).otherwise(0).cast("decimal(12,6)").alias("cost_delta"),
        (F.col("event_id") % 6).cast("int").alias("attempts"),
        F.when(error, "embed").alias("failed_step"),
        F.when(error, F.when(F.col("event_id") % 3 == 0, "RateLimitError").otherwise("ValueError")).alias("error_type"),
        F.when(error, F.repeat(F.concat(F.lit("value "), F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" ")), 200)).alias("error_message"),
        F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("INTERVAL 300 SECONDS")).alias("lease_until"),
        F.col("ts").alias("event_ts"),
    )


def logged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("query_id"),
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("address_id"),
        F.concat(F.lit("m"), F.col("event_id") % 2).alias("model_id"),
        F.round(F.col("value") * 10).cast("int").alias("latency_ms"),
        (F.col("event_id") % 50).cast("int").alias("candidates_examined"),
        (F.col("event_id") % 9).cast("int").alias("chunks_returned"),
        (F.col("event_id") % 7).cast("decimal(12,6)").alias("cost_usd"),
    )


def layout_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, top = F.col("l_quantity") * 10, F.col("l_linenumber") * 6
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("page_id"), x0.alias("x0"), (x0 + 20).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), "l_orderkey", "l_linenumber", "l_partkey")


def table_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, top = F.col("p_size") * 8, F.col("p_partkey") % 37
    cells = F.when(F.col("p_partkey") % 2 == 0, F.array(F.array("p_name", "p_brand"), F.array("p_type", F.lit("x")))).otherwise(F.array(F.array("p_name")))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 200).alias("page_id"), x0.alias("x0"), top.alias("top"), (x0 + 60).alias("x1"), (top + 30).alias("bottom"), cells.alias("cells"))
