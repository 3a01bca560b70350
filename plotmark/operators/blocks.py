"""Queries and vectors that share a key, dealt to blocks in one shuffle; each block multiplies matrices and keeps each
query's best."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmark.sources.storage import stored

SLICE, PART = 1024, 65_536  # queries and vectors in a block, about
TILE = 2_000_000  # distances that are held at once
NEAR = "query_id string, chunk_id string, k int, distance double"


class _Slice:
    """The queries of a block, and the best found for each so far."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.rows: dict[int, list[tuple]] = {}  # by the length of the vector
        self.ready: dict[int, tuple] = {}

    def ask(self, query_id: str, k: int, vector: np.ndarray) -> None:
        self.rows.setdefault(len(vector), []).append((query_id, k, vector))

    def _of(self, length: int) -> tuple | None:
        if length in self.rows:
            ids, ks, vectors = zip(*self.rows.pop(length), strict=True)
            q = np.stack(vectors)
            wanted = [k * self.depth for k in ks]
            self.ready[length] = ids, ks, wanted, q, np.sqrt((q * q).sum(axis=1)), [(np.zeros(0), np.zeros(0, dtype=object))] * len(ids), np.full(len(ids), np.inf)
        return self.ready.get(length)

    def compare(self, ids: np.ndarray, x: np.ndarray) -> None:
        held = self._of(x.shape[1])
        if held is None:
            return
        _, _, wanted, q, norms, best, bound = held
        step = max(1, TILE // len(q))
        for a in range(0, len(x), step):
            own, names = x[a : a + step], ids[a : a + step]
            norm = np.outer(norms, np.sqrt((own * own).sum(axis=1)))
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = np.round(np.where(norm > 0, 1 - (q @ own.T) / norm, np.inf), 9) + 0.0  # no negative zero
            distance[np.isnan(distance)] = np.inf  # stands for NaN, which comes last
            near = distance <= bound[:, None]
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                at = np.flatnonzero(near[i])
                d, n = distance[i, at], wanted[i]
                if len(at) > n:
                    few = d <= np.partition(d, n - 1)[n - 1]
                    at, d = at[few], d[few]
                d, c = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], names[at]])
                order = np.lexsort((c.astype(str), d))[:n]
                best[i] = d[order], c[order]
                if len(order) == n:
                    bound[i] = d[order[-1]]

    def found(self) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for ids, ks, _, _, _, best, _ in self.ready.values():
            for query_id, k, (d, c) in zip(ids, ks, best, strict=True):
                out[0] += [query_id] * len(d)
                out[1] += c.tolist()
                out[2] += [k] * len(d)
                out[3] += np.where(np.isinf(d), np.nan, d).tolist()
        kinds = (pa.string(), pa.string(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=False) for c, t in zip(out, kinds, strict=True)], ["query_id", "chunk_id", "k", "distance"])


def nearest_in_blocks(queries: DataFrame, vectors: DataFrame, keys: list[str], depth: int, per_slice: int = SLICE, per_part: int = PART) -> DataFrame:
    """(query_id, chunk_id, k, distance): of each block the ``depth`` times k vectors nearest to each of its queries by cosine distance.

    ``queries`` are (query_id, k, vector) and ``vectors`` (chunk_id, embedding), both with ``keys``; they meet where all keys are
    equal. The queries of a key are cut into slices of about ``per_slice``, its vectors into parts of about ``per_part``, and each
    pair of them is a block, so a key may be as large as it likes on either side. Both sides go through one shuffle; vectors are
    copied once for each slice, queries once for each part. A block's queries come first and are held, its vectors stream by.
    Only counts of rows by key are taken beforehand, from the columns of the keys."""
    asked = queries.select(*keys, "query_id", "k", "vector").filter(F.col("vector").isNotNull())
    held = vectors.select(*keys, "chunk_id", "embedding")  # null ones go in the blocks: a filter would compute vectors made on the way twice
    count = lambda df, n, most: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias(n))
    layout = count(queries.filter(F.col("vector").isNotNull()), "slices", per_slice).join(count(vectors, "parts", per_part), keys)
    layout = stored(layout, "layout")
    kind = "float" if {asked.schema["vector"].dataType.elementType.simpleString(), held.schema["embedding"].dataType.elementType.simpleString()} == {"float"} else "double"
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    block = F.concat_ws("\x1f", F.to_json(F.struct(*keys)), "part", "slice").alias("block")
    left = asked.join(layout, keys).withColumn("slice", mine("query_id", "slices")).withColumn("part", each("parts"))
    left = left.select(block, F.lit(0).alias("side"), F.col("query_id").alias("id"), "k", F.col("vector").cast(f"array<{kind}>").alias("v"))
    right = held.join(layout, keys).withColumn("part", mine("chunk_id", "parts")).withColumn("slice", each("slices"))
    right = right.select(block, F.lit(1).alias("side"), F.col("chunk_id").alias("id"), F.lit(0).alias("k"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    dealt = left.unionByName(right).repartition("block").sortWithinPartitions("block", "side")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for b in batches:
            b = b.filter(b.column(4).is_valid())
            names = b.column(0).dictionary_encode()
            of, lengths, side = names.indices.to_numpy(), b.column(4).value_lengths().to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(lengths) != 0) | (np.diff(side) != 0)) + 1
            for start, end in pairwise([0, *cuts.tolist(), b.num_rows]):
                if start == end:
                    continue
                name = names.dictionary[int(of[start])].as_py()
                if name != last:
                    if own is not None:
                        yield own.found()
                    own, last = _Slice(depth), name
                run = b.slice(start, end - start)
                x = run.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(end - start, -1)
                ids = run.column(2).to_pylist()
                if side[start]:
                    own.compare(np.array(ids, dtype=object), x)
                else:
                    for query_id, k, v in zip(ids, run.column(3).to_pylist(), x, strict=True):
                        own.ask(query_id, k, v)
        if own is not None:
            yield own.found()

    return dealt.mapInArrow(rank, NEAR)
