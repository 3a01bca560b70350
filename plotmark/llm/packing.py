"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights
with knapsack pricing, then rounded; what rounding leaves goes by best fit, longest first."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotmark.llm.bpe import WordEncoder, public_vocabulary, text_batches
from plotmark.llm.common import docs_of, materialise

CAPACITY = 2048
ROUNDS = 400  # of multiplicative weights
GAP = 0.005  # above the lower bound at which a plan is good enough
RUN = 1_000  # about so many pieces of one length are ranked together


@lru_cache(maxsize=2)
def _word_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Per piece of a document's ids (those of its whole text, then ``end_id``): doc_id, piece, start, length and
    ids_crc32. Only documents of more than ``capacity`` ids have several; null text counts as empty, and an
    empty document is one piece of one id. Ids are those of ``Tokenizer.from_file(path).encode(text,
    add_special_tokens=False)``, with the ids of special tokens where a text holds their strings. The tokenizer must
    drop case and white space; others are refused."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(_word_tokenizer(path), bare=True)
        for b in batches:
            for i, j in text_batches(b.column(1)):
                ids, counts, _ = encoder.encode(b.column(1).slice(i, j - i))
                ends = np.cumsum(counts)
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for k, (lo, hi) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                    own = np.append(ids[lo:hi], end_id).astype("<u4")
                    for n, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append(i + k)
                        pieces.append(n)
                        starts.append(start)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                arrays = [pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), *arrays], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _best_configuration(value: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of at most ``capacity`` in all with the largest value: unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        gains = best[:c][::-1] + value[1 : c + 1]
        k = int(gains.argmax())
        if gains[k] > best[c - 1]:
            best[c], took[c] = gains[k], k + 1
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if k := int(took[c]):
            out[k] = out.get(k, 0) + 1
            c -= k
        else:
            c -= 1
    return out


def configurations(count: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A fractional solution of: fewest sequences so that the configurations cover ``count[l]`` pieces of each
    length l; and a lower bound of that number. Each round prices lengths by their weight, adds the best configuration as
    an equal share of the volume bound, and lowers the weights of what it covers. Prices over the value of their best
    configuration are feasible in the dual program, whose largest value is the bound."""
    lengths = np.flatnonzero(count)
    bound = lower_bound(count, capacity)
    share = max(bound, 1.0) / rounds
    covered, found = np.zeros(len(count)), {}
    value = np.full(len(count), -1.0)
    for _ in range(rounds):
        # A length's natural price is its share of a sequence; what is covered beyond its due gets cheaper.
        due = covered[lengths] / count[lengths]
        value[lengths] = lengths / capacity * np.exp(-np.clip(due - due.min(), 0, 4))
        own = _best_configuration(value, capacity)
        bound = max(bound, float((value[lengths] * count[lengths]).sum()) / sum(value[k] * n for k, n in own.items()))
        for k, n in own.items():
            covered[k] += n * share
        key = tuple(sorted(own.items(), reverse=True))
        found[key] = found.get(key, 0.0) + share
    return [(dict(k), x) for k, x in sorted(found.items(), key=lambda kx: -kx[1])], bound


def lower_bound(count: np.ndarray, capacity: int) -> float:
    """The best of some known solutions of the dual program: prices by volume, steps of a price (so many pieces of a length fit at
    most), and pieces of which one fills a sequence that others can't share."""
    share = np.arange(capacity + 1) / capacity
    best = float((share * count).sum())
    for k in range(1, 65):
        steps = np.arange(capacity + 1) * (k + 1)
        best = max(best, float((np.where(steps % capacity, steps // capacity / k, share) * count).sum()))
    for least in range(1, capacity // 2 + 1):
        best = max(best, float(count[capacity - least + 1 :].sum() + (share * count)[least : capacity - least + 1].sum()))
    return best


def plan(count: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of alike sequences: (lengths with how many of each, number of sequences); every piece is in one.

    The program is solved and rounded, and what is left goes by best fit. If that is more than ``GAP`` above the lower bound, the
    program is also solved anew for what rounding left, and best fit of all pieces is tried: the smallest plan counts, so it never
    has more sequences than best fit, longest first. The size of a plan depends on ``capacity`` alone: it has at most
    ``rounds`` configurations a solution, and best fit splits at most one group for each placement."""
    number = lambda groups: sum(n for _, n in groups)
    best = None
    for solutions in (1, 3, 0):
        found = _rounded(count, capacity, rounds, solutions)
        best = found if best is None or number(found) < number(best) else best
        if number(best) <= np.ceil(lower_bound(count, capacity)) * (1 + GAP):
            break
    return best


def _rounded(count: np.ndarray, capacity: int, rounds: int, solutions: int) -> list[tuple[list[tuple[int, int]], int]]:
    left = count.astype(np.int64).copy()
    groups: list[list] = []  # space, contents, number
    for _ in range(solutions):
        for own, share in configurations(left, capacity, rounds)[0] if left.any() else []:
            n = min(int(np.ceil(share)), min(int(left[k]) // a for k, a in own.items()))
            if n > 0:
                for k, a in own.items():
                    left[k] -= n * a
                groups.append([capacity - sum(k * a for k, a in own.items()), list(own.items()), n])
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, g in enumerate(groups):
        by_space[g[0]].append(i)
    for length in np.flatnonzero(left)[::-1].tolist():
        need = int(left[length])
        for space in range(length, capacity + 1):
            while need and by_space[space]:
                i = by_space[space].pop()
                need = _fill(groups, by_space, i, length, need)
            if not need:
                break
        if need:
            groups.append([capacity, [], -(-need // (capacity // length))])
            need = _fill(groups, by_space, len(groups) - 1, length, need)
    return [(contents, n) for _, contents, n in groups]


def _fill(groups: list[list], by_space: list[list[int]], i: int, length: int, need: int) -> int:
    """Put pieces of ``length`` into the sequences of group ``i``, as many as fit in each; what it cuts off is a
    new group. Returns how many are left."""
    space, contents, n = groups[i]
    each = space // length
    for a in (each, need % each):
        full = min(n, need // a) if a else 0
        if full:
            groups.append([space - a * length, [*contents, (length, a)], full])
            by_space[space - a * length].append(len(groups) - 1)
            n, need = n - full, need - full * a
    groups[i][2] = n
    if n:
        by_space[space].append(i)
    return need


def _places(groups: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first sequence, pieces a sequence, offset of the first), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for contents, n in groups:
        offset = 0
        for length, a in contents if n else []:
            out.setdefault(length, []).append((ranks.get(length, 0), sequence, a, offset))
            ranks[length] = ranks.get(length, 0) + a * n
            offset += a * length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (with a length of 1 to ``capacity``, and doc_id and piece) with sequence_id and offset.

    The driver sees the histogram of lengths alone (at most ``capacity`` rows) and sends back the plan. Pieces of
    a length take its places by rank; ranks come from runs of about ``RUN`` pieces, so a length that a third of
    all pieces have is spread over many tasks. An empty table stays empty; rows that are repeated each get a place.
    """
    pieces = materialise(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    count = np.zeros(capacity + 1, dtype=np.int64)
    count[list(histogram)] = list(histogram.values())
    places = pieces.sparkSession.sparkContext.broadcast(_places(plan(count, capacity, rounds)))
    runs = F.element_at(F.lit(np.maximum(1, -(-count // RUN)).astype(np.int64).tolist()), (F.col("length") + 1).cast("int"))
    split = pieces.withColumn("run", F.pmod(F.xxhash64("doc_id", "piece"), runs))
    sizes = split.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "run", (F.sum("n").over(Window.partitionBy("length").orderBy("run")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "run").orderBy("doc_id", "piece")) - 1
    ranked = split.withColumn("inside", inside).join(before, ["length", "run"]).withColumn("rank", F.col("before") + F.col("inside"))
    ranked = ranked.select(*pieces.columns, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                own, rows = np.flatnonzero(length == k), table[k]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                past = rank[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 1] + past // row[:, 2], row[:, 3] + past % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack whole documents; see ``token_pieces`` and ``pack``. A null id is passed on, repeated rows are each
    packed, an empty table gives an empty result, and other columns are ignored."""
    return pack(token_pieces(docs, path or public_vocabulary("word_bpe_49k.json"), capacity), capacity)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
