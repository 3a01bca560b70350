"""Overlapping token windows over a document's segments, with provenance."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotmark.functions.text import at_or_before, key_id, let, prefix_sums

CHUNK_TOKENS, OVERLAP = 600, 100
SEPARATOR = "\n\n"
TOKEN = "[ \\t\\n\\r]*[^ \\t\\n\\r]+|[ \\t\\n\\r]+"


def document_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), SEPARATOR)


def segment_starts(segments: Column) -> Column:
    """Where each segment begins in the document's text, in code points."""
    return prefix_sums(F.transform(segments, lambda s: F.char_length(s["text"]) + len(SEPARATOR)))


def tokens(text: Column) -> Column:
    """Tokens for sizing: words with the white space before them. Joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def window_count(n: Column, size: int, overlap: int) -> Column:
    """How many windows cover ``n`` tokens, the last being the first that reaches the end."""
    more = F.ceil((n - size) / (size - overlap)).cast("int")
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + more)


class FileTokenizer:
    """Offsets of the tokens of texts, by a tokenizer file that every worker finds at ``path``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        return [e.offsets for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def pieces_of(text: str, offsets: list[tuple[int, int]]) -> list[str]:
    """``text`` cut into one piece for each token, which joined are the text: a character that several tokens share is the first one's,
    what lies between tokens is the next one's, and what follows the last is its own. Without tokens there are no pieces."""
    ends = list(accumulate((end for _, end in offsets), max))
    if ends:
        ends[-1] = len(text)
    return [text[a:b] for a, b in pairwise([0, *ends])]


def tokens_with(documents: DataFrame, make_tokenizer: Callable[[], object], size: int = 2_000_000) -> DataFrame:
    """``documents`` with ``tokens``, the pieces of each one's text by a tokenizer of the user's: ``make_tokenizer`` is called once for each
    task, and returns an object with ``offsets(texts)``, the (start, end) in characters of the tokens of each text. About ``size`` bytes
    of text are tokenised at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make_tokenizer()
        for b in batches:
            part = np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False)) // size
            for i, j in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]):
                own = b.slice(i, j - i)
                texts = own.column(own.num_columns - 1).to_pylist()
                pieces = [pieces_of(t, o) for t, o in zip(texts, tokenizer.offsets(texts), strict=True)] if texts else []
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(pieces, pa.list_(pa.string()))], [*own.schema.names[:-1], "tokens"])

    rows = documents.drop("tokens").withColumn("whole_text", F.coalesce(document_text(F.col("segments")), F.lit("")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, tokens array<string>")


def chunk_documents(documents: DataFrame, chunk_tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP, make_tokenizer: Callable[[], object] | None = None) -> DataFrame:
    """(document_id, address_id, doc_version, segments) to chunk rows, sized by words or by the tokens of ``make_tokenizer`` (see
    ``tokens_with``).

    All happens within the document's row, which is then inlined: no shuffle, and only finished chunks are copied.
    A chunk belongs to the last segment that starts at or before it. Documents without text have no chunks.
    """
    if not 0 <= overlap < chunk_tokens:
        raise ValueError("overlap must be less than chunk_tokens, and neither negative")
    step = chunk_tokens - overlap

    def window(begin: Column, i: Column, words: Column, part: Column) -> Column:
        def chunk(own: Column) -> Column:
            text = F.array_join(own, "")
            return F.struct(
                i.alias("ordinal"),
                part["page_number"].alias("page_number"),
                part["paragraph_index"].alias("paragraph_index"),
                begin.cast("int").alias("char_start"),
                (begin + F.char_length(text)).cast("int").alias("char_end"),
                text.alias("text"),
                F.size(own).alias("token_count"),
            )

        return let(F.slice(words, i * step + 1, F.lit(chunk_tokens)), chunk)

    def windows(words: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), window_count(F.size(words), chunk_tokens, overlap) - 1), lambda i: F.char_length(F.array_join(F.slice(words, i * step + 1, F.lit(step)), "")))
        parts = F.col("segments")

        def located(begins: Column) -> Column:
            of = at_or_before(begins, segment_starts(parts))
            return let(of, lambda n: F.transform(begins, lambda begin, i: window(begin, i, words, F.get(parts, F.get(n, i) - 1))))

        return let(prefix_sums(steps), located)

    some = documents.select("document_id", "address_id", "doc_version", "segments").filter(F.exists("segments", lambda s: s["text"] != ""))
    words = tokens(document_text(F.col("segments")))
    if make_tokenizer is not None:
        some, words = tokens_with(some, make_tokenizer).filter(F.size("tokens") > 0), F.col("tokens")
    rows = some.select("document_id", "address_id", "doc_version", F.inline(let(words, windows)))
    return rows.select(key_id(F.col("document_id"), F.col("doc_version"), F.col("ordinal")).alias("chunk_id"), "document_id", "address_id", "doc_version", "ordinal", "page_number", "paragraph_index", "char_start", "char_end", "text", "token_count")


def segment_rows(documents: DataFrame) -> DataFrame:
    """(document_id, start, page_number, paragraph_index): the segments of (document_id, segments) as rows, and where each begins."""
    parts = F.arrays_zip(segment_starts(F.col("segments")).alias("start"), F.col("segments").alias("segment"))
    return documents.select("document_id", F.inline(parts)).select("document_id", "start", "segment.page_number", "segment.paragraph_index")


def locate(positions: DataFrame, segments: DataFrame, position: str = "position") -> DataFrame:
    """``positions`` (document_id, ``position``, and others) with page_number and paragraph_index of the last of ``segments``
    (document_id, start, page_number, paragraph_index) that starts at or before it; null where none does.

    Both are sorted together by document once, so the work is linear in their rows and nothing is compared pairwise. Of segments that
    start at one place the later one counts."""
    segment = F.struct("page_number", "paragraph_index")
    asked = positions.select("document_id", F.col(position).cast("long").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(segments.select(segment.alias("s")).schema["s"].dataType).alias("segment"), F.struct(*positions.columns).alias("row"))
    given = segments.select("document_id", F.col("start").cast("long").alias("at"), F.lit(0).alias("asks"), segment.alias("segment"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    so_far = Window.partitionBy("document_id").orderBy("at", "asks", "segment").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(given).withColumn("found", F.last("segment", ignorenulls=True).over(so_far)).filter("asks = 1")
    return found.select("row.*", "found.page_number", "found.paragraph_index")


def replace_version_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with the chunks of every (document, version) in ``new`` replaced; doing it again changes nothing."""
    versions = new.select("document_id", "doc_version").distinct()
    return stored.join(versions, ["document_id", "doc_version"], "left_anti").select(*stored.columns).unionByName(new)


def version_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks of the named (document_id, doc_version) in order."""
    return chunks.join(versions.select("document_id", "doc_version").distinct(), ["document_id", "doc_version"], "left_semi").select(*chunks.columns).orderBy("document_id", "ordinal")
