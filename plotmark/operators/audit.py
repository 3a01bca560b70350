"""Integrity checks: each returns the rows that break a rule of the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmark.schemas import STATES
from plotmark.sources.storage import storage_ref


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(table_name, key, copies) of keys that several rows have."""

    def of(df: DataFrame, name: str, *keys: str) -> DataFrame:
        many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        return many.select(F.lit(name).alias("table_name"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), "copies")

    return _all([of(documents, "document", "address_id", "upload_id"), of(chunks, "chunk", "document_id", "doc_version", "ordinal"), of(embeddings, "embedding", "chunk_id")])


def orphans(addresses: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(rule, key): chunks without their document, embeddings without their chunk, documents without their address, and
    storage paths that several uploads share."""
    lost = lambda rule, df, key, of, on: df.join(of.select(on).distinct(), on, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).alias("key"))
    shared = documents.groupBy(storage_ref("store", F.col("address_id"), F.col("upload_id")).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _all(
        [
            lost("chunk without document", chunks, "chunk_id", documents, "document_id"),
            lost("embedding without chunk", embeddings, "chunk_id", chunks, "chunk_id"),
            lost("document without address", documents, "document_id", addresses, "address_id"),
            shared.select(F.lit("shared storage path").alias("rule"), "key"),
        ]
    )


def address_leaks(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, results: DataFrame) -> DataFrame:
    """(rule, key): rows whose address is not that of what they belong to."""

    def of(rule: str, df: DataFrame, key: str, owner: DataFrame, on: str) -> DataFrame:
        both = df.select(F.col(key).alias("key"), F.col(on).alias("owner"), F.col("address_id").alias("own")).join(owner.select(F.col(on).alias("owner"), "address_id"), "owner")
        return both.filter(~F.col("own").eqNullSafe(F.col("address_id"))).select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"))

    return _all([of("chunk", chunks, "chunk_id", documents, "document_id"), of("embedding", embeddings, "chunk_id", chunks, "chunk_id"), of("result", results, "query_id", queries, "query_id")])


def domain_violations(jobs: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, models: DataFrame) -> DataFrame:
    """(rule, key): unknown job states, vectors of a wrong length, missing values, live versions with gaps."""
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    registered = models.select("model_id", F.col("dim").alias("model_dim"))
    wrong = embeddings.join(registered, "model_id", "left").filter(~((F.size("embedding") == F.col("dim")) & F.col("dim").eqNullSafe(F.col("model_dim"))) | F.col("embedding").isNull())
    live = documents.filter("live_version > 0").select("document_id", F.col("live_version").alias("doc_version"))
    spans = chunks.join(live, ["document_id", "doc_version"]).groupBy("document_id").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_distinct("ordinal").alias("n"))
    return _all(
        [
            row(jobs.filter(~F.coalesce(F.col("state").isin(*STATES), F.lit(False))), "unknown state", "task_id"),
            row(wrong, "wrong dimension", "chunk_id"),
            row(chunks.filter(F.col("text").isNull() | F.col("address_id").isNull() | F.col("document_id").isNull()), "missing value", "chunk_id"),
            row(spans.filter("lo <> 0 or hi <> n - 1"), "gap in ordinals", "document_id"),
        ]
    )
