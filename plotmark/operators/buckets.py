"""A stored index of vectors by hyperplane buckets, and search in the buckets that a query is likely to find its neighbours in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmark.operators.blocks import PART, SLICE, nearest_in_blocks
from plotmark.operators.search import DEPTH, best_of, vector_topk
from plotmark.sources.storage import dataset_name

TABLES, BITS, RECALL, SAMPLE, SEED = 4, 6, 0.95, 64, 7
KEYS = ["address_id", "table_no", "bucket"]


class Hyperplanes:
    """Buckets by the signs of random directions, ``BITS`` in each of ``TABLES`` tables."""

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Rows, tables, bits."""
        directions = np.random.default_rng(SEED).normal(size=(x.shape[1], TABLES * BITS))
        return (x @ directions).reshape(len(x), TABLES, BITS)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return (self.projected(x) > 0) @ (1 << np.arange(BITS))

    def order(self, x: np.ndarray) -> np.ndarray:
        """All buckets of each table, the likeliest first (those that differ in the directions a row is nearest to): rows,
        tables, 2 ** BITS."""
        p = self.projected(x)
        flips = (np.arange(1 << BITS)[:, None] >> np.arange(BITS)) & 1
        cost = (p**2) @ flips.T
        own = (p > 0) @ (1 << np.arange(BITS))
        return np.arange(1 << BITS)[np.argsort(cost, axis=2, kind="stable")] ^ own[:, :, None]


def _hashed(df: DataFrame, column: str, buckets_of) -> DataFrame:
    """``df`` with (table_no, bucket) of each of its rows, one row for each that ``buckets_of`` (matrix to rows, tables, buckets) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(b.schema.get_field_index(column))
            lengths = vectors.value_lengths().to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                if not length:
                    continue
                x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)
                found = buckets_of(np.nan_to_num(x))
                _, tables, each = found.shape
                places = [pa.array(np.tile(np.repeat(np.arange(tables), each), len(rows)), pa.int32()), pa.array(found.ravel(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(np.repeat(rows, tables * each))).columns, *places], [*b.schema.names, "table_no", "bucket"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.filter(F.col(column).isNotNull()).mapInArrow(run, f"{fields}, table_no int, bucket int")


@dataclass
class BucketIndex:
    """(chunk_id, address_id, embedding, table_no, bucket) as stored, and how many tables and buckets of each a query visits."""

    table: DataFrame
    tables: int
    probes: int


def _calibrated(embeddings: DataFrame, recall: float, sample: int, k: int) -> tuple[int, int]:
    """(tables, probes) at which ``sample`` vectors (by the hash of their ids) find a share of ``recall`` of their ``k`` true
    neighbours. Where that means to visit as many vectors as there are, one table with all buckets, which is exact."""
    queries = embeddings.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample)
    queries = queries.select(F.col("chunk_id").alias("query_id"), "address_id", F.lit(k + 1).alias("k"), F.col("embedding").alias("vector"))
    true = vector_topk(queries, embeddings, 1).filter("query_id <> chunk_id").select("query_id", "chunk_id")
    pairs = true.join(embeddings.select("chunk_id", "embedding"), "chunk_id").join(queries.select("query_id", "vector"), "query_id").select("vector", "embedding").collect()
    pairs = [r for r in pairs if len(r["vector"]) == len(pairs[0]["vector"])]
    if not pairs:
        return TABLES, 1
    q, e = (np.nan_to_num(np.array([r[c] for r in pairs], dtype=np.float64)) for c in ("vector", "embedding"))
    place = (Hyperplanes().order(q) == Hyperplanes().buckets(e)[:, :, None]).argmax(axis=2).min(axis=1)
    probes = int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1
    visited = sum(r["n"] for r in _visits(queries, embeddings, probes).collect())
    exact = queries.groupBy("address_id").agg(F.count(F.lit(1)).alias("q")).join(embeddings.groupBy("address_id").agg(F.count("embedding").alias("e")), "address_id").agg(F.sum(F.col("q") * F.col("e")).alias("n")).first()["n"]
    return (TABLES, probes) if visited < exact else (1, 1 << BITS)


def _visits(queries: DataFrame, embeddings: DataFrame, probes: int) -> DataFrame:
    asked = _hashed(queries.select("address_id", "vector"), "vector", lambda x: Hyperplanes().order(x)[:, :, :probes]).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("q"))
    held = _hashed(embeddings.select("address_id", "embedding"), "embedding", lambda x: Hyperplanes().buckets(x)[:, :, None]).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("e"))
    return asked.join(held, KEYS).agg(F.coalesce(F.sum(F.col("q") * F.col("e")), F.lit(0)).alias("n"))


def write_bucket_index(embeddings: DataFrame, path: str, model_id: str, recall: float = RECALL, sample: int = SAMPLE, k: int = 12) -> None:
    """Store one model's embeddings (chunk_id, address_id, embedding) by table and bucket, once for each table, in folders by which
    readers are spared what no query visits; and how many buckets queries must visit, measured on ``sample`` of them. A
    bucket that holds a large share of the vectors is written by several tasks."""
    tables, probes = _calibrated(embeddings, recall, sample, k)
    rows = _hashed(embeddings.select("chunk_id", "address_id", "embedding"), "embedding", lambda x: Hyperplanes().buckets(x)[:, :tables, None])
    rows = rows.withColumn("model_slug", dataset_name(F.lit(model_id))).hint("rebalance", "table_no", "bucket")
    keys = ["model_slug", "table_no", "bucket"]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/buckets")
    settings = embeddings.sparkSession.range(1).select(F.lit(tables).alias("tables"), F.lit(probes).alias("probes"), dataset_name(F.lit(model_id)).alias("model_slug"))
    settings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_slug").parquet(f"{path}/settings")


def read_bucket_index(spark: SparkSession, path: str, model_id: str) -> BucketIndex:
    own = F.col("model_slug") == dataset_name(F.lit(model_id))
    settings = spark.read.parquet(f"{path}/settings").filter(own).first()
    if settings is None:
        raise ValueError(f"no bucket index for {model_id}")
    return BucketIndex(spark.read.parquet(f"{path}/buckets").filter(own).drop("model_slug"), settings["tables"], settings["probes"])


def _probed(queries: DataFrame, index: BucketIndex) -> DataFrame:
    asked, tables, probes = queries.select("query_id", "address_id", "k", "vector"), index.tables, index.probes
    return _hashed(asked, "vector", lambda x: Hyperplanes().order(x)[:, :tables, :probes])


def hyperplane_topk(queries: DataFrame, index: BucketIndex, depth: int = DEPTH, per_slice: int = SLICE, per_part: int = PART) -> DataFrame:
    """As ``vector_topk``, but a query is compared only with embeddings of its address in the buckets that it visits: an equi-join of
    probed and stored buckets. Distances are computed exactly. ``recall_of`` measures the result, ``compared_share`` the work."""
    near = nearest_in_blocks(_probed(queries, index), index.table, KEYS, depth, per_slice, per_part)
    return best_of(near.groupBy("query_id", "chunk_id").agg(F.first("k").alias("k"), F.min("distance").alias("distance")), depth)


def compared_share(queries: DataFrame, index: BucketIndex) -> DataFrame:
    """One row, ``share``: distances that ``hyperplane_topk`` computes over those that exact search does."""
    each = lambda df, keys, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    pairs = lambda a, b, keys, name: each(a, keys, "q").join(each(b, keys, "e"), keys).select((F.col("q") * F.col("e")).alias(name))
    some = pairs(_probed(queries, index).select(*KEYS), index.table, KEYS, "some")
    whole = pairs(queries.filter(F.col("vector").isNotNull()), index.table.filter("table_no = 0"), ["address_id"], "whole")
    both = some.unionByName(whole, allowMissingColumns=True).agg(F.coalesce(F.sum("some"), F.lit(0)).alias("some"), F.sum("whole").alias("whole"))
    return both.select(F.try_divide("some", "whole").alias("share"))
