"""Approximate nearest neighbours by multiprobe p-stable hashing: perturbed buckets are visited in the order of their
estimated success, the candidates of all tables merged and ranked by exact inner products."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotmark.llm.common import list_column, materialise, thinned

TABLES, WIDTH = 4, 1.5  # hash tables, and the width of a cell in standard deviations
HASHES, ROWS_AT, MORE_AT = 4, 50_000, 4  # one hash more for each MORE_AT-fold of ROWS_AT rows
PROBES = 256  # buckets of a table that a query visits at most; if they don't give the recall, there are fewer hashes
SAMPLE, RECALL = 64, 0.96  # queries whose true neighbours set the number of probes, and the recall they must reach
SHARD, ASKED = 4096, 1024  # vectors, and queries, that are compared together


def probe_sets(hashes: int, n: int) -> np.ndarray:
    """The first ``n`` sets of boundaries to cross, as rows of 0 and 1 over a query's boundaries by distance, by the sum of
    their expected squared distances: the less a query must move, the likelier a neighbour is there. Crossing both
    boundaries of one hash is no set; the first set is empty. (After the multi-probe sequence of Lv et al., 2007: sets
    are generated in order from a heap, so that the 3 ** hashes of them are never listed.)"""
    m = hashes
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    i = np.arange(m, 0, -1)
    cost = np.concatenate([near, 1 - i / (m + 1) + i * (i + 1) / (4 * (m + 1) * (m + 2))])
    out = [np.zeros(2 * m, dtype=np.int8)]
    heap = [(cost[0], (0,))] if m else []
    while heap and len(out) < n:
        total, own = heapq.heappop(heap)
        if all(2 * m - 1 - x not in own for x in own):
            out.append(np.isin(np.arange(2 * m), own).astype(np.int8))
        if own[-1] + 1 < 2 * m:
            more = own[-1] + 1
            heapq.heappush(heap, (total - cost[own[-1]] + cost[more], (*own[:-1], more)))
            heapq.heappush(heap, (total + cost[more], (*own, more)))
    return np.stack(out)


@dataclass
class Hashes:
    """p-stable hash functions of every table over vectors scaled to the largest norm; ``probes`` buckets are visited."""

    directions: np.ndarray  # tables, hashes, dimensions + 1
    shifts: np.ndarray
    width: float
    sets: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Positions in units of cells: rows, tables, hashes."""
        return (np.einsum("nd,lkd->nlk", x, self.directions) + self.shifts) / self.width

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit key of each bucket, given whole cells (rows, tables, ..., hashes)."""
        tables = np.arange(1, cells.shape[1] + 1, dtype=np.int64) * 0x51ED270B
        h = np.broadcast_to(tables.reshape(1, -1, *[1] * (cells.ndim - 3)), cells.shape[:-1]).copy()
        for i in range(cells.shape[-1]):
            h = (h ^ (cells[..., i].astype(np.int64) + 0x9E37)) * np.int64(0x5851F42D4C957F2D)
            h ^= h >> 29
        return h

    def visits(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Keys of the buckets that queries visit, in order: rows, tables, probes."""
        cells = self.cells(x)
        past = cells - np.floor(cells)
        order = np.concatenate([past, 1 - past], axis=-1).argsort(axis=-1, kind="stable")  # rows, tables, boundaries
        m = cells.shape[-1]
        way = np.zeros((*order.shape, m), dtype=np.int8)
        np.put_along_axis(way, (order % max(m, 1))[..., None], np.where(order < m, -1, 1).astype(np.int8)[..., None], axis=-1)
        steps = np.einsum("pb,nlbk->nlpk", self.sets[first:last], way)
        return self.keys(np.floor(cells)[:, :, None, :] + steps)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def _lifted(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Vectors scaled into the unit ball with one more component, so that near means a large inner product: data get
    what is missing to norm 1, queries are brought to norm 1."""
    if query:
        return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
    x = x / norm
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def _best(query: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each query, each other vector once."""
    order = np.lexsort((other, -score, query))
    q, v = query[order], other[order]
    first = np.ones(len(q), dtype=bool)  # a pair found twice has one score, so its rows are neighbours
    first[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    order, q = order[first], q[first]
    begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return order[place < k]


def _compare(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of queries, id, score) of the ``k`` best pairs of each query that reach its ``floor``; products are summed
    alike for alike vectors."""
    near = queries @ vectors.T
    least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(axis=1)
    least = np.maximum(least, floor)
    q, v = np.nonzero(near >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
    score = np.concatenate([(queries[q[i : i + 65536]] * vectors[v[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
    kept = _best(q, ids[v], score, k)
    return q[kept], ids[v[kept]], score[kept]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part: not null, no null or non-finite component, not zero."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(v.isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """For each row of ``vectors`` for which ``is_query`` (a condition on vec_id) holds, its ``k`` nearest other rows
    by inner product in double precision: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    Every vector is in one bucket of each table, every query visits the same number of buckets in each: as many as
    a sample of ``SAMPLE`` queries needs to find ``recall`` of their true neighbours (found by brute force, against
    all rows). The number of hashes grows with the rows; where ``PROBES`` buckets of each table don't give the recall, there
    is one hash less, and so on down to none, which is exact search. Of rows with the same vector only the ``k`` + 1 of the
    smallest ids can be among anyone's nearest, so no more are hashed, and equal queries search once: results
    stay whole.

    Buckets are gathered in shards. A query's vector goes once to every shard that has buckets of its, with their list; a
    shard of more than ``SHARD`` vectors or ``ASKED`` queries is split both ways, so a task holds no more than that
    however many meet in a bucket. Queries visit their likeliest buckets first, and of later ones only what reaches their
    best so far is sent on. The few whose buckets hold fewer than ``k`` others are compared with all vectors.

    Defined cases: null ids, and vectors that are null, zero, of another length than most, or hold a null or
    non-finite component take no part, as query or candidate; with fewer than ``k`` candidates all that are found
    are returned; a repeated row (same id) is one row; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    length = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not length:
        return spark.createDataFrame([], schema)
    d = length[0]["d"]
    alike = Window.partitionBy("h1", "h2").orderBy("vec_id")
    rows = rows.filter(F.size("vector") == d).dropDuplicates(["vec_id"]).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})
    rows = materialise(rows.withColumn("query", F.coalesce(is_query, F.lit(False))), "vectors")
    data = rows.withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= k + 1).select("vec_id", "vector")
    data = materialise(data, "data")
    asked = rows.filter("query").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"))
    members = rows.filter("query").select("vec_id", "h1", "h2").join(asked, ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "rep")
    queries = materialise(rows.join(asked.select(F.col("rep").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "vector"), "queries")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(squares)).alias("norm")).first()

    hashes = _fitted(data, queries, facts["n"], facts["norm"], d, k, recall)
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        """The k + 1 best of each query, with their place."""
        once = found.groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)

    def floors(found: DataFrame) -> DataFrame:
        """Queries with the least score that reaches their best so far; null if they have fewer than k + 1."""
        reached = found.filter(F.col("place") == k + 1).select(F.col("rep").alias("vec_id"), F.col("score").alias("floor"))
        return queries.join(reached, "vec_id", "left")

    # The likeliest buckets come first; what they give is the least that those after them must reach to be sent on.
    search, probes = _searcher(data, hashes, facts["n"], facts["norm"], d, k), len(hashes.sets)
    early = max(1, probes // 8)
    found = materialise(top(search(queries.withColumn("floor", F.lit(float("-inf"))), 0, early)), "early")
    if early < probes:
        asked = floors(found).withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = materialise(top(found.drop("place").unionByName(search(asked, early, probes))), "found")
    # Queries whose buckets hold too few are compared with all vectors.
    short = floors(found).filter("floor is null").withColumn("floor", F.lit(float("-inf")))
    if len(hashes.directions[0]) and not short.isEmpty():
        whole = _searcher(data, _hashes(0, 1, d), facts["n"], facts["norm"], d, k)
        found = top(found.drop("place").unionByName(whole(short, 0, 1)))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = members.join(found, "rep").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")


def _searcher(data: DataFrame, hashes: Hashes, n: int, norm: float, d: int, k: int):
    """A function of queries (vec_id, vector, floor) and the first and last probe that they make: (rep, vec_id, score) of the
    best in these buckets, those of each block of a shard."""
    tables = len(hashes.directions)
    shards = max(1, -(-n * tables // SHARD))
    shared = data.sparkSession.sparkContext.broadcast((hashes, norm))
    vector_type = data.schema["vector"].dataType.simpleString()

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, norm = shared.value
        for b in batches:
            keys = hashes.keys(np.floor(hashes.cells(_lifted(_matrix(b.column(1), d), norm, False)))).ravel()
            at = pa.array(np.repeat(np.arange(b.num_rows), tables))
            own = list_column(keys, np.ones(len(keys), np.int32), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys % shards), own, *(c.take(at) for c in b.columns)], ["shard", "buckets", "vec_id", "vector"])

    def visits(first: int, last: int):
        """The shards and buckets that a query visits from its ``first`` up to its ``last`` probe of each table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, norm = shared.value
            for batch in batches:
                for b in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                    keys = hashes.visits(_lifted(_matrix(b.column(1), d), norm, True), first, last).reshape(b.num_rows, -1)
                    of = np.repeat(np.arange(b.num_rows), keys.shape[1])
                    order = np.lexsort((keys.ravel() % shards, of))
                    of, keys = of[order], keys.ravel()[order]
                    begins = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (keys[1:] % shards != keys[:-1] % shards)]))
                    own = list_column(keys, np.diff(np.append(begins, len(keys))), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[begins] % shards), own, *(c.take(pa.array(of[begins])) for c in b.columns)], ["shard", "buckets", "vec_id", "vector", "floor"])

        return run

    fields = f"shard long, buckets array<long>, vec_id long, vector {vector_type}"
    placed = data.mapInArrow(buckets, fields)
    sizes = materialise(placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts")), "sizes")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, sealed = None, [], None
        for batch in batches:
            keys, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *change], [*change, batch.num_rows], strict=True):
                if i == j:
                    continue
                if keys[i] != block:
                    block, held, sealed = keys[i], [], None
                if not asks[i]:
                    held.append(batch.slice(i, j - i))
                    continue
                if sealed is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held)
                    bucket = t.column("buckets").combine_chunks().flatten().to_numpy()
                    order = np.argsort(bucket, kind="stable")
                    sealed, held = (bucket[order], t.column("vec_id").to_numpy()[order], _matrix(t.column("vector").combine_chunks(), d)[order]), []
                for lo in range(i, j, 512):
                    yield from _answers(batch.slice(lo, min(512, j - lo)), sealed, d, k + 1)

    def visited(asked: DataFrame, first: int, last: int) -> DataFrame:
        asking = materialise(asked.mapInArrow(visits(first, last), f"{fields}, floor double"), "visits")
        counted = asking.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("slices"))
        both = materialise(sizes.join(counted, "shard"), "grid")
        at = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = placed.join(both, "shard").select("*", at(F.col("parts")).alias("part"), every("slices").alias("slice")).withColumns({"asks": F.lit(False), "floor": F.lit(None).cast("double")})
        theirs = asking.join(both, "shard").select("*", at(F.col("slices")).alias("slice"), every("parts").alias("part")).withColumn("asks", F.lit(True))
        rows = own.unionByName(theirs).select(F.xxhash64("shard", "part", "slice").alias("block"), "asks", "buckets", "vec_id", "vector", "floor")
        return rows.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(search, "rep long, vec_id long, score double")

    return visited


def _answers(asked: pa.RecordBatch, data: tuple[np.ndarray, np.ndarray, np.ndarray], d: int, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each query among the vectors, sorted by bucket, of the buckets that it visits."""
    bucket, ids, vectors = data
    lists = asked.column(2)
    keys = lists.flatten().to_numpy()
    of = np.repeat(np.arange(asked.num_rows), lists.value_lengths().to_numpy())
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    x, reps, floor = _matrix(asked.column(4), d), asked.column(3).to_numpy(), asked.column(5).to_numpy()
    found: list[tuple[np.ndarray, ...]] = []
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    for i, j in zip(begins, [*begins[1:], len(keys)], strict=True):
        lo, hi = np.searchsorted(bucket, keys[i], "left"), np.searchsorted(bucket, keys[i], "right")
        if lo < hi:
            some = of[i:j]
            q, v, score = _compare(x[some], vectors[lo:hi], ids[lo:hi], k, floor[some])
            found.append((reps[some][q], v, score))
    if found:
        q, v, score = (np.concatenate(f) for f in zip(*found, strict=True))
        own = _best(q, v, score, k)
        yield pa.RecordBatch.from_arrays([pa.array(f[own]) for f in (q, v, score)], ["rep", "vec_id", "score"])


def _hashes(hashes: int, probes: int, d: int) -> Hashes:
    draw, tables = np.random.default_rng(17), TABLES if hashes else 1
    directions = draw.normal(size=(tables, hashes, d + 1))  # projections of unit vectors have a standard deviation of 1
    return Hashes(directions, draw.uniform(0, WIDTH, size=(tables, hashes)), WIDTH, probe_sets(hashes, probes))


def _fitted(data: DataFrame, queries: DataFrame, n: int, norm: float, d: int, k: int, recall: float) -> Hashes:
    """Hash functions with as many buckets to visit in each table as a sample of queries needs to find ``recall`` of their
    true neighbours, which are found by comparing the sample with all rows."""
    hashes = HASHES + max(0, int(np.log(max(n, 1) / ROWS_AT) / np.log(MORE_AT)))

    drawn = thinned(queries, "vec_id", SAMPLE).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not drawn:
        return _hashes(0, 1, d)
    ids, x = np.array([r["vec_id"] for r in drawn]), np.array([r["vector"] for r in drawn], dtype=np.float64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others = b.column(0).to_numpy()
            q, v, s = _compare(x, _matrix(b.column(1), d), others, k + 1)
            where = pa.array(np.searchsorted(others, v, sorter=(order := np.argsort(others))))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), b.column(1).take(pa.array(order).take(where))], ["q", "vec_id", "score", "vector"])

    kind = data.schema["vector"].dataType.simpleString()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    truth = data.mapInArrow(compare, f"q long, vec_id long, score double, vector {kind}")
    truth = truth.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).collect()
    truth = [r for r in truth if r["vec_id"] != ids[r["q"]]]
    if not truth:
        return _hashes(0, 1, d)
    q, there = np.array([r["q"] for r in truth]), _lifted(np.array([r["vector"] for r in truth], dtype=np.float64), norm, False)
    while hashes:
        tried = _hashes(hashes, PROBES, d)
        same = tried.visits(_lifted(x, norm, True))[q] == tried.keys(np.floor(tried.cells(there)))[:, :, None]
        rank = np.where(same.any(axis=2), same.argmax(axis=2), PROBES).min(axis=1)
        needed = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))))])
        if needed < PROBES:
            return _hashes(hashes, needed + 1, d)
        hashes -= 1
    return _hashes(0, 1, d)


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
