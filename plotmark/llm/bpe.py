"""Byte-level BPE encoding and decoding over Arrow batches, with the tokenizers library.

Encoding is exact on whole texts but works on their words: every pattern used here begins a new match where a
character that is no white space is followed by one that is, so a text may be cut there, each distinct word
encoded once, and the ids joined.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmark.llm.common import docs_of, list_column

_RUNS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space (and NUL) besides single spaces and newlines, some of which engines class differently.
_ODD = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_IRREGULAR = _ODD + r"|[ \n][ \n]"
_WIDE = r"[^\x00-\x{ff}]"
CACHE_WORDS, CACHE_OFFSETS = 400_000, 120_000  # words that a worker keeps before it begins afresh, without and with offsets
JOINED, JOIN_CHARS = 200, 64  # new words that are encoded as one text, and the longest of them
BATCH_BYTES, BATCH_OFFSETS = 4_000_000, 1_500_000  # of texts that are encoded together, without and with offsets
#: Lower-case letters of Latin-1, which normal form and lower case leave alone, and marks of ASCII but the apostrophe.
_LETTERS, _MARKS = r"[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]", r"[!-&(-/:-@\[-`{-~]"
_SIMPLE, _STEM = rf"\A{_LETTERS}+{_MARKS}*\z", rf"\A({_LETTERS}+)({_MARKS}+)\z"
#: The steps of a tokenizer of which it is known that the letters and the marks of such a word are one match each.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_MATCHES = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def text_batches(texts: pa.Array, size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` bytes, so that memory follows the longest text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def _stay_letters(word: str) -> bool:
    if word.isascii():
        return word.isalpha()
    return word.isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFC", word).lower()).isalpha()


def words_of(text: str) -> list[str]:
    """``text`` cut before each run of white space that follows something else; uncut if it has white space of a kind
    that engines may class differently."""
    common = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    return _RUNS.findall(text) if " ".join(common.split()) == " ".join(filter(None, common.split(" "))) else [text]


class SimpleWords:
    """Ids of words of letters, and maybe marks after them, by the model of a tokenizer alone: such words need no normal form,
    and each of their matches ends with an id whose token has the suffix of ends."""

    def __init__(self, tokenizer) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = tokenizer.model.end_of_word_suffix
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.bare = Tokenizer(tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.shown = {i: c for i, c in enumerate(byte_chars()) if i != ord(" ")}

    @staticmethod
    def fit(tokenizer, added: list[str]) -> bool:
        """Whether ``tokenizer`` is of the kind for which this gives its ids."""
        from tokenizers import models

        model = tokenizer.model
        if not isinstance(model, models.BPE) or not model.end_of_word_suffix or model.continuing_subword_prefix or model.dropout:
            return False
        if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None or tokenizer.truncation or tokenizer.padding:
            return False
        steps = [json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
        if steps != [_NORMAL, {"type": "Sequence", "pretokenizers": [_MATCHES, _BYTES]}]:
            return False
        known = tokenizer.get_vocab(with_added_tokens=False)
        whole = all(c in known and c + model.end_of_word_suffix in known for c in byte_chars())
        part = re.compile(re.sub(r"\\x{(..)}", r"\\x\1", f"{_LETTERS}*{_MARKS}*"), re.IGNORECASE)
        return whole and not any(part.fullmatch(a) for a in added)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has); all match ``_SIMPLE``."""
        parted = pc.replace_substring_regex(words, _STEM, r"\1 \2")
        matches = 1 + pc.count_substring(parted, " ").to_numpy(zero_copy_only=False)
        cuts = pa.array(np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32))
        texts = pc.binary_join(pa.ListArray.from_arrays(cuts, parted), " ").to_pylist()
        got = self.bare.encode_batch_fast([t.encode().decode("latin-1").translate(self.shown) for t in texts], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, dtype=np.int32) for e in got)])
        last = np.flatnonzero(self.ends[ids])[np.cumsum(matches) - 1]
        return ids, np.diff(last, prepend=-1).astype(np.int32)


class WordEncoder:
    """Encodes texts by way of their distinct words, whose ids (and offsets) are held in flat arrays."""

    def __init__(self, tokenizer, offsets: bool = False, bare: bool = False) -> None:
        if offsets and bare:
            raise ValueError("offsets are of texts as they are")
        self.tokenizer, self.offsets = tokenizer, offsets
        self.between = " " if bare else ""
        added = [] if tokenizer.encode_special_tokens else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        #: Texts with such a string, in any case, are encoded whole.
        self.special = "(?i)" + "|".join(re.escape(a) for a in added) if added else None
        self.simple = SimpleWords(tokenizer) if bare and SimpleWords.fit(tokenizer, added) else None
        self._forget()
        if bare and self._encoded(["Ab.\n c  D"])[0][0].tolist() != np.concatenate(self._encoded(["ab", ".", "c", "d"])[0]).tolist():
            raise ValueError("this tokenizer keeps case or white space")

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text, in Arrow; where white space is dropped, so are case and spaces (only Latin-1 is
        lower-cased here, for which all engines agree)."""
        if self.between:
            odd = pc.match_substring_regex(texts, _ODD)
            lower = pc.if_else(pc.match_substring_regex(texts, _WIDE), texts, pc.utf8_lower(texts))
            words = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        else:
            odd = pc.match_substring_regex(texts, _IRREGULAR)
            words = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n"), " ", "\0 "), "\0")
        if self.special:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.special))
        if not pc.any(odd).as_py():
            return words
        own = zip(odd.to_pylist(), texts.to_pylist(), words.to_pylist(), strict=True)
        return pa.array([(([t] if self._is_special(t) else words_of(t)) if o else w) for o, t, w in own], type=pa.list_(pa.string()))

    def _is_special(self, text: str) -> bool:
        return bool(self.special and re.search(self.special, text))

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.simple_words, self.simple_at = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.counts, self.ids, self.spans = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((0, 2), np.int32)

    def _encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.int32) for e in got], [np.array(e.offsets, dtype=np.int32).reshape(-1, 2) for e in got]

    def _learn(self, words: set[str]) -> None:
        """Take in new words. Where white space is dropped, letters before a full stop or comma are encoded without it, if they are
        letters in lower case as well (that of some ends in a mark, which the stop would join)."""
        stopped = [w for w in words if w.endswith((".", ",")) and _stay_letters(w[:-1])] if self.between else []
        if not stopped:
            return self._learn_whole(list(words))
        stems = [w[:-1] for w in stopped]
        self._learn_whole(list(words.difference(stopped).union(stems, ".,").difference(self.index)))
        for mark in ".,":
            some = [(w, self.index[s]) for w, s in zip(stopped, stems, strict=True) if w[-1] == mark]
            stem = np.array([i for _, i in some], dtype=np.int64)
            own = self._ids_at(self.index[mark])
            counts = self.counts[stem]
            where = np.repeat(self._starts()[stem] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            ids = np.insert(self.ids[where], np.repeat(np.cumsum(counts), len(own)), np.tile(own, len(some)))
            self.index.update(zip([w for w, _ in some], range(len(self.counts), len(self.counts) + len(some)), strict=True))
            self.counts, self.ids = np.concatenate([self.counts, counts + np.int32(len(own))]), np.concatenate([self.ids, ids])

    def _starts(self) -> np.ndarray:
        return np.cumsum(self.counts, dtype=np.int64) - self.counts

    def _ids_at(self, i: int) -> np.ndarray:
        start = int(self.counts[:i].sum())
        return self.ids[start : start + int(self.counts[i])]

    def _learn_whole(self, words: list[str]) -> None:
        """Take in new words. Those that begin a match wherever they stand are joined and encoded many at once."""
        joins, apart = [], []
        for w in words:
            (joins if len(w) <= JOIN_CHARS and w.strip() and (self.between or w[0] in " \n") and not self._is_special(w) else apart).append(w)
        parts = [joins[i : i + JOINED] for i in range(0, len(joins), JOINED)]
        ids, spans = self._encoded([self.between.join(p) for p in parts])
        counts = []
        for i, part in enumerate(parts):
            lengths = np.fromiter(map(len, part), dtype=np.int32, count=len(part)) + len(self.between)
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            counts.append(np.diff(np.searchsorted(spans[i][:, 0], starts)).astype(np.int32))
            spans[i] = spans[i] - np.repeat(starts[:-1], counts[-1])[:, None]
        more_ids, more_spans = self._encoded(apart)
        counts.append(np.array([len(x) for x in more_ids], dtype=np.int32))
        self.index.update(zip([*joins, *apart], range(len(self.counts), len(self.counts) + len(words)), strict=True))
        self.counts = np.concatenate([self.counts, *counts])
        self.ids = np.concatenate([self.ids, *ids, *more_ids])
        if self.offsets:
            self.spans = np.concatenate([self.spans, *spans, *more_spans])

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """The place of each of these words; new ones are learnt. Simple ones are never Python's strings."""
        if self.simple is None:
            return self._indexed(distinct)
        distinct = distinct.cast(pa.string())  # Spark may hand over large strings
        simple = pc.match_substring_regex(distinct, _SIMPLE)
        mask = simple.to_numpy(zero_copy_only=False)
        at = np.zeros(len(distinct), np.int64)
        at[~mask] = self._indexed(distinct.filter(pc.invert(simple)))
        own = distinct.filter(simple)
        place = pc.index_in(own, self.simple_words)
        new = own.filter(pc.is_null(place))
        if len(new):
            ids, counts = self.simple.encode(new)
            self.simple_at = np.append(self.simple_at, len(self.counts) + np.arange(len(new)))
            self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        place = place.fill_null(-1).to_numpy(zero_copy_only=False)
        at[mask] = self.simple_at[np.where(place < 0, len(self.simple_words) - 1 + np.cumsum(place < 0), place)]
        self.simple_words = pa.concat_arrays([self.simple_words, new])
        return at

    def _indexed(self, distinct: pa.Array) -> np.ndarray:
        words = distinct.to_pylist()
        self._learn(set(words).difference(self.index))
        return np.array([self.index[w] for w in words], dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids of all texts, how many each text has, offsets or None); offsets are pairs of code points, start and end."""
        words = self._cut(texts)
        found = words.flatten().dictionary_encode()
        most = CACHE_OFFSETS if self.offsets else CACHE_WORDS
        if len(self.index) + len(self.simple_words) > most or len(self.ids) > 8 * most:
            self._forget()
        at = self._places(found.dictionary)[found.indices.to_numpy()]
        per_words = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        counts = self.counts[at]
        first = np.cumsum(counts, dtype=np.int64) - counts  # of each word's ids in the result
        where = np.repeat(self._starts()[at] - first, counts) + np.arange(counts.sum())
        of = np.repeat(np.arange(len(texts)), per_words)
        per_text = np.bincount(of, weights=counts, minlength=len(texts)).astype(np.int64)
        if not self.offsets:
            return self.ids[where], per_text, None
        lengths = pc.utf8_length(found.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[found.indices.to_numpy()]
        chars = np.bincount(of, weights=lengths, minlength=len(texts)).astype(np.int64)
        begins = np.cumsum(lengths) - lengths - np.repeat(np.cumsum(chars) - chars, per_words)
        return self.ids[where], per_text, self.spans[where] + np.repeat(begins, counts)[:, None].astype(np.int32)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def byte_tokenizer(path: str, pattern: str):
    """A tokenizers.Tokenizer that gives the ids of the ranks in ``path``: a word that is itself a token takes its
    id, else the adjacent pair whose joined bytes have the lowest rank is merged first."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    shown = {b: "".join(chars[x] for x in b) for b in ranks}
    merges = [
        (shown[b[:i]], shown[b[i:]])
        for b, _ in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(b))
        if b[:i] in ranks and b[i:] in ranks
    ]
    t = Tokenizer(models.BPE(vocab={shown[b]: r for b, r in ranks.items()}, merges=merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
    t.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id its number of bytes (-1 if there is no such id), where they start, and all bytes; they come from
    reversing the characters that stand for bytes in the vocabulary."""
    chars = byte_chars()
    back = {c: i for i, c in enumerate(chars)}
    shown = {i: "".join(chars[x] for x in b) for b, i in read_ranks(path).items()}
    own = [bytes(back[c] for c in shown[i]) if i in shown else None for i in range(max(shown, default=-1) + 1)]
    sizes = np.array([-1 if b is None else len(b) for b in own], dtype=np.int64)
    held = np.maximum(sizes, 0)
    return sizes, np.cumsum(held) - held, np.frombuffer(b"".join(filter(None, own)), dtype=np.uint8)


def encode_bytes(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids, starts and ends (code points of each id's characters; the ids of a character that is
    split over several all carry that character). ``path`` is a file of ranks found on every worker.

    Null text counts as empty and gives empty arrays; whole texts are encoded, whatever their length; ids are
    passed on, null or repeated. No shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(byte_tokenizer(path, pattern), offsets=True)
        for b in batches:
            for i, j in text_batches(b.column(1), BATCH_OFFSETS):
                ids, counts, spans = encoder.encode(b.column(1).slice(i, j - i))
                lists = [list_column(x, counts, pa.int32()) for x in (ids, spans[:, 0], spans[:, 1])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *lists], ["doc_id", "ids", "starts", "ends"])

    rows = docs_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, ids, bytes (null where an id is unknown or null), n_tokens and text, the bytes as UTF-8 with
    U+FFFD for what is cut inside a character. Null ids count as none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, starts, table = byte_table(path)
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                lists = b.column(1)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                per_row = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(len(per_row)), per_row)
                unknown = (ids < 0) | (ids >= len(sizes))
                ids = np.where(unknown, 0, ids)
                unknown |= sizes[ids] < 0
                counts = np.where(unknown, 0, sizes[ids])
                where = np.repeat(starts[ids] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                ends = np.cumsum(np.bincount(of, weights=counts, minlength=len(per_row)).astype(np.int64))
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(per_row), [None, pa.py_buffer(offsets), pa.py_buffer(table[where])])
                bad = np.bincount(of, weights=unknown, minlength=len(per_row)) > 0
                if bad.any():
                    data = pc.if_else(pa.array(bad), pa.scalar(None, pa.binary()), data)
                yield pa.RecordBatch.from_arrays([b.column(0), lists, data], ["doc_id", "ids", "bytes"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(decode, f"doc_id {kind}, ids array<int>, bytes binary")
    return out.withColumns({"n_tokens": F.size("ids").cast("long"), "text": F.make_valid_utf8(F.col("bytes").cast("string"))})


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    got = decode_ids(encode_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, pattern), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
