"""Exact deduplication (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmark.llm.common import docs_of, materialise


def content_hash(text: Column) -> Column:
    """128-bit hash of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Mark copies: rows whose whole texts have the same bytes form a group.

    Returns per input row: doc_id, keep_id, group_size, kept, text_sha256. ``keep`` is "max" (the largest id
    stays) or "min".

    Rows are grouped by the 128-bit ``digest`` and, inside it, by the bytes themselves, so a collision splits
    into groups of its own. The grouping is a partial aggregate: a text that a third of all rows share leaves
    each task as one row. The rows then find their group by the digest alone (16 bytes); only those
    of digests that are seen to collide carry the text as well.

    Defined cases: null text is the empty text; empty texts are equal; a null id never stays unless all ids
    of the group are null; rows repeated with the same id and text are each marked kept; an empty table gives
    an empty result; other columns are ignored.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    rows = docs_of(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    stays = F.max("doc_id") if keep == "max" else F.min("doc_id")
    groups = rows.groupBy("digest", "text").agg(stays.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    thin = materialise(groups.select("digest", "keep_id", "group_size", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "exact")
    collide = materialise(thin.groupBy("digest").count().filter("count > 1").select("digest"), "collide")
    if not collide.isEmpty():
        joined = rows.join(collide, "digest", "left_anti").drop("text").join(thin, "digest")
        some = rows.join(collide, "digest", "left_semi")
        sha = groups.join(collide, "digest", "left_semi").withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        joined = joined.unionByName(some.join(materialise(sha, "collided"), ["digest", "text"]).drop("text"))
    else:
        joined = rows.drop("text").join(thin, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
