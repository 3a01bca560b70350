"""Sum-of-squares online packing: each document goes to the fill level that leaves the smallest sum of squared counts of
partially filled windows; what is still open at the end is poured together, so that no window is padded."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plotmark.llm.bpe import _IRREGULAR, JOIN_CHARS, JOINED, WordEncoder, public_vocabulary, text_batches, words_of
from plotmark.llm.common import docs_of

CAPACITY, END_ID = 2048, 1
MAX_OPEN = 1024  # partially filled windows that a task holds; beyond it the emptiest are poured into the fullest
CACHE_WORDS = 800_000  # that a worker remembers before it begins afresh
#: A letter and a mark that follows it are always in different matches of the pattern.
_STOP = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,!?;:])"


class PieceEncoder(WordEncoder):
    """``WordEncoder`` for byte-level vocabularies without offsets: marks after letters are words of their own, and the
    ids of words that were encoded together are told apart by the one id of each that begins with its white space."""

    def __init__(self, tokenizer) -> None:
        super().__init__(tokenizer)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in "ĠĊ"]] = True  # a space and a newline in such vocabularies

    def _forget(self) -> None:
        if not getattr(self, "index", None) or len(self.index) > CACHE_WORDS:
            super()._forget()

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        odd = pc.match_substring_regex(texts, _IRREGULAR)
        if self.special:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.special))
        marked = pc.replace_substring_regex(texts, _STOP, "\\1\0\\2")
        words = pc.split_pattern(pc.replace_substring(pc.replace_substring(marked, "\n", "\0\n"), " ", "\0 "), "\0")
        if not pc.any(odd).as_py():
            return words
        own = zip(odd.to_pylist(), texts.to_pylist(), words.to_pylist(), strict=True)
        return pa.array([(([t] if self._is_special(t) else words_of(t)) if o else w) for o, t, w in own], type=pa.list_(pa.string()))

    def _learn_whole(self, words: list[str]) -> None:
        joins, apart = [], []
        for w in words:
            plain = 1 < len(w) <= JOIN_CHARS and w[0] in " \n" and not w[-1].isspace() and " " not in w[1:] and "\n" not in w[1:]
            (joins if plain and not (self.special and "<" in w) else apart).append(w)
        ids, counts, order = [], [], []
        for i in range(0, len(joins), JOINED):
            part = joins[i : i + JOINED]
            own = np.array(self.tokenizer.encode("".join(part), add_special_tokens=False).ids, dtype=np.int32)
            starts = np.flatnonzero(self.begins[own])
            if len(starts) != len(part) or starts[0]:
                apart += part
                continue
            order += part
            ids.append(own)
            counts.append(np.diff(np.append(starts, len(own))).astype(np.int32))
        more = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch(apart, add_special_tokens=False)]
        counts.append(np.array([len(x) for x in more], dtype=np.int32))
        self.index.update(zip([*order, *apart], range(len(self.counts), len(self.counts) + len(words)), strict=True))
        self.counts = np.concatenate([self.counts, *counts])
        self.ids = np.concatenate([self.ids, *ids, *more])


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    """One for all tasks of a worker, so that words are learnt once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Tokenizer

    return PieceEncoder(Tokenizer.from_file(path))


class Windows:
    """Windows of ``capacity`` that are partly filled, by fill level. Pieces are [document, start, ids]."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN) -> None:
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # of partly filled windows at each level
        self.at: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.full: list[list] = []  # finished windows, until they are taken

    def best_level(self, size: int) -> int:
        """The level (0: a new window) at which a piece makes the sum of squares smallest; of equal ones the fullest."""
        end = self.capacity - size
        levels = np.flatnonzero(self.count[1 : end + 1]) + 1
        if not len(levels):
            return 0
        change = 2 * (self.count[levels + size] - self.count[levels] + 1)
        change[levels == end] -= 1  # a window that becomes full isn't counted any more
        i = len(levels) - 1 - int(change[::-1].argmin())
        return int(levels[i]) if change[i] <= 2 * self.count[size] + 1 else 0

    def add(self, document: int, ids: np.ndarray) -> None:
        """Whole windows of a document are finished at once, and the rest of it is placed."""
        n, size = len(ids), len(ids) % self.capacity
        self.full += [[[document, a, ids[a : a + self.capacity]]] for a in range(0, n - size, self.capacity)]
        if size:
            level = self.best_level(size)
            self._put(level + size, [*(self._take(level) if level else ()), [document, n - size, ids[n - size :].copy()]])
            if self.open > self.max_open:
                self.pour(self.max_open // 2)

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def _put(self, level: int, window: list) -> None:
        if level == self.capacity:
            self.full.append(window)
        elif level:
            self.count[level] += 1
            self.open += 1
            self.at[level].append(window)

    def pour(self, leave: int) -> None:
        """Fill up the fullest windows with pieces of the emptiest, cut where need be, until at most ``leave`` are open."""
        while self.open > max(leave, 1):
            levels = np.flatnonzero(self.count)
            high, low = int(levels[-1]), int(levels[0])
            window, giver = self._take(high), self._take(low)
            gap = min(self.capacity - high, low)
            high, low = high + gap, low - gap
            while gap:
                document, start, ids = giver.pop()
                if len(ids) > gap:
                    giver.append([document, start + gap, ids[gap:]])
                    ids = ids[:gap]
                window.append([document, start, ids])
                gap -= len(ids)
            self._put(high, window)
            self._put(low, giver)

    def finish(self) -> None:
        """Pour everything together; the last window, if not full, is cut into sequences whose sizes are powers of two."""
        self.pour(1)
        for level in np.flatnonzero(self.count).tolist():
            rest = self._take(level)
            for size in (1 << b for b in range(level.bit_length() - 1, -1, -1) if level >> b & 1):
                own = []
                while size:
                    document, start, ids = rest.pop()
                    if len(ids) > size:
                        rest.append([document, start + size, ids[size:]])
                        ids = ids[:size]
                    own.append([document, start, ids])
                    size -= len(ids)
                self.full.append(own)


def pack_windows(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", max_open: int = MAX_OPEN) -> DataFrame:
    """Per piece of a document's ids (those of its whole text, then ``end_id``): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id and offset. Every id is in one piece; sequences are full, but for a few a task whose sizes are
    powers of two.

    Each task packs the rows of its partition in their order, and holds at most ``max_open`` windows, so there is no
    shuffle and memory doesn't follow the partition. Ids are those of ``Tokenizer.from_file(path).encode(text,
    add_special_tokens=False)``, where the path is found on every worker. Null text counts as empty, an empty document
    is one piece of one id, ids are passed on, null or repeated, other columns are ignored, and an empty table stays
    empty. A task that is run again gives the same if its rows come in the same order, as those of files do."""
    rows = docs_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = _encoder(path), Windows(capacity, max_open)
        sequence = TaskContext.get().partitionId() << 33
        named: dict[int, tuple] = {}  # of each document with open pieces: id, number of its ids
        last, id_type = 0, None

        def finished() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, named
            out: list[tuple] = []
            for window in windows.full:
                offset = 0
                for document, start, ids in window:
                    doc_id, total = named[document]
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                    offset += len(ids)
                sequence += 1
            windows.full = []
            held = {p[0] for level in np.flatnonzero(windows.count) for w in windows.at[level] for p in w}
            named = {k: named[k] for k in held}
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for b in batches:
            id_type = b.schema.field(0).type
            for i, j in text_batches(b.column(1)):
                ids, counts, _ = encoder.encode(b.column(1).slice(i, j - i))
                ends = np.cumsum(counts)
                for doc_id, lo, hi in zip(b.column(0).slice(i, j - i).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    last += 1
                    named[last] = (doc_id, hi - lo + 1)
                    windows.add(last, np.append(ids[lo:hi], np.int32(end_id)))
                yield from finished()
        windows.finish()
        yield from finished()

    return rows.mapInArrow(pack, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op11_window_packing(spark, sf_dir: str) -> DataFrame:
    return pack_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary("byte_bpe_50k.json"))
