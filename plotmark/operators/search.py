"""Batch search: every query ranks the live chunks of its own address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotmark.operators.blocks import PART, SLICE, nearest_in_blocks
from plotmark.operators.lexical import match_all, query_lexemes, rank_matches
from plotmark.sources.storage import stored

DEFAULT_K, MAX_K, RRF_K, DEPTH = 8, 100, 60, 4


def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of their document's live version."""
    live = documents.select("document_id", F.col("live_version").alias("doc_version")).filter("doc_version > 0")
    return chunks.join(live, ["document_id", "doc_version"], "left_semi").select(*chunks.columns)


def live_embeddings(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Embeddings of live chunks. Versions that aren't live, and then the ids of all other embeddings, are found first and written as
    tables: where they are few, as they mostly are, neither chunks nor vectors are shuffled for it, but only ids."""
    version = ["document_id", "doc_version"]
    ids = chunks.select("chunk_id", *version).filter("document_id is not null and doc_version is not null")
    past = stored(ids.select(*version).distinct().join(documents.filter("live_version > 0").select("document_id", F.col("live_version").alias("doc_version")), version, "left_anti"), "past")
    named = embeddings.filter(F.col("chunk_id").isNotNull())
    dead = stored(named.select("chunk_id").join(ids.join(past, version, "left_anti").select("chunk_id"), "chunk_id", "left_anti"), "dead")
    return named.join(dead, "chunk_id", "left_anti").select(*embeddings.columns)


def _live_among(found: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The live ones of those chunks that ``found``, a stored table, names; only these are joined with documents."""
    return live_chunks(chunks.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi").select(*chunks.columns), documents)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine, in double precision; NaN if either vector is zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(1 - _dot(a, b) / F.when(norm != 0, norm))


def vector_topk(queries: DataFrame, embeddings: DataFrame, depth: int = DEPTH, per_slice: int = SLICE, per_part: int = PART) -> DataFrame:
    """(query_id, chunk_id, distance, vector_rank): for each of ``queries`` (query_id, address_id, k, vector) the
    ``depth`` times k nearest embeddings of its address. Distances are rounded to 9 places; ties go to the smaller
    chunk_id; null vectors, and those of another length than the query's, take no part.

    Queries and embeddings of an address meet in blocks, see ``nearest_in_blocks``: neither side goes through the driver or is
    broadcast, and the vectors are read once, however many queries there are."""
    return best_of(nearest_in_blocks(queries, embeddings, ["address_id"], depth, per_slice, per_part), depth)


def best_of(near: DataFrame, depth: int) -> DataFrame:
    """The ranking of each query, from the best of each block."""
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    ranked = near.withColumn("vector_rank", F.row_number().over(order)).filter(F.col("vector_rank") <= depth * MAX_K)
    return ranked.filter(F.col("vector_rank") <= F.col("k") * depth).select("query_id", "chunk_id", "distance", "vector_rank")


def text_topk(queries: DataFrame, postings: DataFrame, config: str = "english", depth: int = DEPTH) -> DataFrame:
    """(query_id, chunk_id, text_rank, rank): for each query the ``depth`` times k best matches of all its lexemes in its
    address. Ties go to the smaller chunk_id."""
    return _best_matches(queries, match_all(postings, query_lexemes(queries, config)), depth)


def _best_matches(queries: DataFrame, matches: DataFrame, depth: int = DEPTH) -> DataFrame:
    ranked = rank_matches(matches).withColumn("text_rank", F.round("text_rank", 9))
    ranked = ranked.join(queries.select("query_id", "k"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("text_rank"), "chunk_id")
    best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth * MAX_K)
    return best.filter(F.col("rank") <= F.col("k") * depth).select("query_id", "chunk_id", "text_rank", "rank")


def fuse(vector: DataFrame, text: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score): reciprocal ranks of both lists, summed; what a list lacks adds nothing."""
    v = vector.select("query_id", "chunk_id", "vector_rank")
    t = text.select("query_id", "chunk_id", F.col("rank").alias("text_place"))
    part = lambda c: F.coalesce(1.0 / (F.col(c) + rrf_k), F.lit(0.0))
    return v.join(t, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", (part("vector_rank") + part("text_place")).alias("score"))


def cite(fused: DataFrame, queries: DataFrame, chunks: DataFrame, documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The k best of each query with text and citation, from live ``chunks``; hits of the text alone survive without an embedding
    (model_id is then empty). Ties: document, ordinal, chunk."""
    where = chunks.join(documents.select("document_id", "original_name", "storage_ref"), "document_id")
    found = fused.join(where, "chunk_id").join(queries.select("query_id", F.col("address_id").alias("asked"), "k"), "query_id").filter(F.col("asked") == F.col("address_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "document_id", "ordinal", "chunk_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MAX_K).filter(F.col("rank") <= F.col("k"))
    best = best.join(embeddings.select("chunk_id", "model_id"), "chunk_id", "left")
    return best.select(
        "query_id",
        "address_id",
        F.coalesce("model_id", F.lit("")).alias("model_id"),
        "rank",
        "text",
        F.round("score", 6).alias("score"),
        F.struct("chunk_id", "document_id", "original_name", "storage_ref", "page_number", "paragraph_index", "ordinal").alias("citation"),
    )


def hybrid_search(queries: DataFrame, chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, postings: DataFrame, config: str = "english") -> DataFrame:
    """Vector and full-text rankings over live chunks, fused; ``queries`` carry their vectors.

    Matches and what is found are written as tables, so that their size is known and chunks aren't shuffled to be joined with few."""
    return _hybrid(queries, chunks, documents, embeddings, live_embeddings(embeddings, chunks, documents), postings, config)


def _hybrid(queries: DataFrame, chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, alive: DataFrame, postings: DataFrame, config: str) -> DataFrame:
    vector = vector_topk(queries.filter(F.col("vector").isNotNull()), alive)
    matches = stored(match_all(postings, query_lexemes(queries, config)), "matches")
    text = _best_matches(queries, matches.join(_live_among(matches, chunks, documents).select("chunk_id"), "chunk_id", "left_semi"))
    return _cited(fuse(vector, text), queries, chunks, documents, embeddings)


def _cited(fused: DataFrame, queries: DataFrame, chunks: DataFrame, documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    found = stored(fused, "found")
    own = embeddings.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return cite(found, queries, _live_among(found, chunks, documents), documents, own)


def vector_search(queries: DataFrame, chunks: DataFrame, documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Hybrid search without its text half."""
    vector = vector_topk(queries, live_embeddings(embeddings, chunks, documents))
    none = vector.select("query_id", "chunk_id", F.col("vector_rank").alias("rank")).limit(0)
    return _cited(fuse(vector, none), queries, chunks, documents, embeddings)


def candidates_examined(queries: DataFrame, chunks: DataFrame, documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(query_id, candidates_examined): live embeddings of the query's address."""
    return _examined(queries, embeddings.join(live_chunks(chunks, documents).select("chunk_id"), "chunk_id", "left_semi"))


def _examined(queries: DataFrame, alive: DataFrame) -> DataFrame:
    counted = alive.groupBy("address_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.join(counted, "address_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("int").alias("candidates_examined"))


def validate_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): text of at least one character, k from 1 to 100 (8 if null)."""
    filled = queries.withColumn("k", F.coalesce("k", F.lit(DEFAULT_K)))
    good = F.coalesce((F.char_length("query_text") >= 1) & F.col("k").between(1, MAX_K) & F.col("address_id").isNotNull(), F.lit(False))
    return filled.filter(good), filled.filter(~good)


def query_log(queries: DataFrame, results: DataFrame, examined: DataFrame, model_id: str, created_at: Column, latency_ms: int | None = None) -> DataFrame:
    """One row for each query, those without results too."""
    returned = results.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = queries.select("query_id", "address_id").join(examined, "query_id", "left").join(returned, "query_id", "left")
    return rows.select(
        "query_id",
        "address_id",
        F.lit(model_id).alias("model_id"),
        F.lit(latency_ms).cast("int").alias("latency_ms"),
        F.coalesce("candidates_examined", F.lit(0)).alias("candidates_examined"),
        F.coalesce("n", F.lit(0)).alias("chunks_returned"),
        F.lit(0).cast("decimal(12,6)").alias("cost_usd"),
        created_at.alias("created_at"),
    )


def query_job(queries: DataFrame, chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, postings: DataFrame, embed_queries, model_id: str, created_at: Column, config: str = "english") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, log, rejected) of a batch of queries under the active model; ``embed_queries`` maps (query_id,
    query_text) to (query_id, vector)."""
    valid, rejected = validate_queries(queries)
    asked = valid.join(embed_queries(valid), "query_id", "left")
    active = embeddings.filter(F.col("model_id") == model_id)
    alive = live_embeddings(active, chunks, documents)
    results = _hybrid(asked, chunks, documents, active, alive, postings, config)
    return results, query_log(valid, results, _examined(valid, alive), model_id, created_at), rejected


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row, ``recall``: the share of the exact (query_id, chunk_id) that are found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
