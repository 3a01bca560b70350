"""Raw uploads, stored tables and their names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Content types by file extension; anything else is a PDF by default.
TYPES = {
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
    "csv": "text/csv",
    "json": "application/json",
    "pdf": "application/pdf",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster's machines share, which ``spark.checkpoint.dir`` names. Only on a single machine, where
    every folder is shared, there is a new one under /tmp if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new table in the shared folder, read back: computed once, safe from lost executors, of known size."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_uploads_partitioned(spark: SparkSession, root: str) -> DataFrame:
    """Uploads under ``address=<id>/doc=<upload>/original``: address_id and upload_id come from the folders."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "original").load(root)
    return raw.select(F.col("address").cast("string").alias("address_id"), F.col("doc").cast("string").alias("upload_id"), F.col("path").alias("storage_ref"), F.col("content").alias("data"), F.col("modificationTime").alias("upload_ts"))


def stream_uploads(spark: SparkSession, root: str, name: str = "original", files: int | None = None) -> DataFrame:
    """Uploads that arrive under ``address=<id>/doc=<upload>/``, in files whose names match ``name``, as a stream of at most ``files``
    in a batch."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    raw = reader.options(pathGlobFilter=name, recursiveFileLookup="true", **({"maxFilesPerTrigger": files} if files else {})).load(root)
    folder = lambda key: F.url_decode(F.replace(F.regexp_extract("path", f"/{key}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    return raw.select(folder("address").alias("address_id"), folder("doc").alias("upload_id"), F.col("path").alias("storage_ref"), F.col("content").alias("data"), F.col("modificationTime").alias("upload_ts"))


def read_uploads_plain(spark: SparkSession, root: str) -> DataFrame:
    """Uploads under ``<root>/<address>/<upload>``, one file each; the content type follows the extension."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    address, name = F.regexp_extract("path", "([^/]+)/[^/]+$", 1), F.regexp_extract("path", "([^/]+)$", 1)
    return raw.select(
        address.alias("address_id"),
        name.alias("upload_id"),
        name.alias("filename"),
        content_type_of(name).alias("content_type"),
        F.col("path").alias("storage_ref"),
        F.col("content").alias("data"),
        F.col("modificationTime").alias("upload_ts"),
    )


def content_type_of(filename: Column) -> Column:
    """The content type that a file name's extension stands for; null if none is known."""
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.try_element_at(types, F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1)))


def safe_segment(value: Column) -> Column:
    """``value`` with all but letters, numerals, ``-``, ``_`` and ``.`` made ``_``; unlike values may meet."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}_.-]", "_")


def storage_ref(root: str, address_id: Column, upload_id: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/address="), safe_segment(address_id), F.lit("/doc="), safe_segment(upload_id), F.lit("/original"))


def dataset_name(model_id: Column) -> Column:
    """The name under which a model's embeddings are stored."""
    return F.concat(F.lit("embedding_"), F.regexp_replace(F.regexp_replace(F.lower(model_id), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def address_bucket(address_id: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(address_id), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Write an index table by address bucket; only the buckets in ``df`` are replaced. Embeddings also get a folder
    for each model."""
    keys = ["address_bucket"]
    df = df.withColumn("address_bucket", address_bucket(F.col("address_id"), buckets))
    if "model_id" in df.columns and "embedding" in df.columns:
        df = df.withColumn("model_slug", dataset_name(F.col("model_id")))
        keys = ["model_slug", "address_bucket"]
    df.repartition(*keys, F.pmod(F.xxhash64(df.columns[0]), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_table(spark: SparkSession, path: str, model_id: str | None = None) -> DataFrame:
    """Read an index table; of embeddings exactly one model's folder is read."""
    df = spark.read.parquet(path)
    if "model_slug" in df.columns:
        if model_id is None:
            raise ValueError("name the model whose embeddings are read")
        slug = spark.range(1).select(dataset_name(F.lit(model_id)).alias("s")).first()["s"]
        df = df.filter(F.col("model_slug") == slug).filter(F.col("model_id") == model_id).drop("model_slug")
    return df.drop("address_bucket")
