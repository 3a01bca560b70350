"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmark.sources.storage import stored


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, survives
    lost executors, and gives the planner true sizes for its join choices."""
    return stored(df, f"plotmark-{name}")


def docs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone, so that other columns of the input can't clash; null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` from batches sorted by it; a run may span batches. Whoever calls this has bounded
    the rows of a key before the shuffle."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = [0, *cuts.tolist()]
        ends = [*cuts.tolist(), batch.num_rows]
        for a, b in zip(starts, ends, strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def thinned(df: DataFrame, key: str, n: int, slack: int = 4) -> DataFrame:
    """About ``slack`` times ``n`` rows of ``df`` (all, if it has fewer) by the hash of ``key``, so that a sorted limit of
    ``n`` of them brings the driver no more than that, however many tasks there are."""
    share = min(1.0, slack * n / max(df.count(), 1))
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) <= share * (1 << 30))
