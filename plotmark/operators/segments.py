"""From bytes, page text and table cells to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmark.functions.text import collapse, let, lines, paragraphs, strip
from plotmark.sources.storage import stored

CHARS_PER_PAGE = 250
SPARSE = 0.4
_MARKER = r"(?U)^---PAGE\s+([0-9]+)---\s*$"


def decode_bytes(data: Column) -> Column:
    """UTF-8 text; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def looks_like_pdf(data: Column, content_type: Column) -> Column:
    return F.coalesce(content_type == "application/pdf", F.lit(False)) | F.coalesce(F.substring(data, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def split_by_format(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(PDF uploads, text uploads)."""
    pdf = looks_like_pdf(F.col("data"), F.col("content_type"))
    return uploads.filter(pdf), uploads.filter(~pdf)


def _segments(texts: Column, page: Column) -> Column:
    return F.transform(texts, lambda t, i: F.struct(page.cast("int").alias("page_number"), i.alias("paragraph_index"), t.alias("text")))


def paragraph_segments(text: Column) -> Column:
    """Segments of plain text: its paragraphs, all on page 1."""
    return _segments(paragraphs(text), F.lit(1))


def page_marker_segments(text: Column) -> Column:
    """Segments of text in which lines ``---PAGE n---`` begin pages; what stands before the first is page 1, and
    paragraphs count from 0 in each block between markers."""

    def blocks(rows: Column) -> Column:
        found = F.transform(rows, lambda x, i: F.struct(i.alias("at"), F.nullif(F.regexp_extract(strip(x), _MARKER, 1), F.lit("")).try_cast("int").alias("page")))
        marks = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(1).alias("page"))), F.filter(found, lambda s: s["page"].isNotNull()))

        def cut(own: Column) -> Column:
            ends = F.concat(F.transform(F.slice(own, 2, F.size(own)), lambda s: s["at"]), F.array(F.size(rows)))
            return F.zip_with(own, ends, lambda m, end: _segments(paragraphs(F.array_join(F.slice(rows, m["at"] + 2, end - m["at"] - 1), "\n")), m["page"]))

        return F.flatten(let(marks, cut))

    return let(lines(F.coalesce(text, F.lit(""))), blocks)


def table_text(cells: Column) -> Column:
    """Cells as lines of `` | ``-separated text, blank rows left out; empty unless two rows and two columns remain."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    rows = F.filter(F.coalesce(cells, F.array().cast("array<array<string>>")), lambda r: F.coalesce(F.exists(r, lambda c: ~blank(c)), F.lit(False)))
    text = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: collapse(F.coalesce(c, F.lit("")))), " | ")), "\n")
    real = (F.size(rows) >= 2) & (F.array_max(F.transform(rows, lambda r: F.size(r))) >= 2)
    return F.when(F.coalesce(real, F.lit(False)), text).otherwise("")


def exclude_in_tables(objects: DataFrame, boxes: DataFrame) -> DataFrame:
    """Layout objects whose midpoint is in no box of a real table on their page (edges count as inside). Coordinates are finite;
    objects without a midpoint or page stay.

    Boxes and midpoints are dealt to the cells of grids, whose widths are powers of two: a box to the at most four cells that it meets
    of the grid as wide as it is, a midpoint to its cell in each grid of its page. So a crowded page is many small joins."""
    edges = [F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")]
    real = boxes.filter(table_text(F.col("cells")) != "").select("page_id", *edges).filter("x1 >= x0 and bottom >= top")
    level = F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top"), F.lit(1e-6)))).cast("int")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.pow(F.lit(2.0), "level")), F.floor(F.col(b) / F.pow(F.lit(2.0), "level"))))
    dealt = real.withColumn("level", level).withColumn("cell_x", cells("x0", "x1")).withColumn("cell_y", cells("top", "bottom"))
    levels = stored(real.select("page_id", level.alias("level")).distinct(), "levels")

    mid = [((F.col(a) + F.col(b)) / 2).cast("double").alias(c) for a, b, c in (("x0", "x1", "mid_x"), ("top", "bottom", "mid_y"))]
    points = objects.select("page_id", *mid).distinct().join(levels, "page_id")
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level"))
    points = points.withColumns({"cell_x": cell("mid_x"), "cell_y": cell("mid_y")})
    met = points.join(dealt, ["page_id", "level", "cell_x", "cell_y"]).filter(F.col("mid_x").between(F.col("x0"), F.col("x1")) & F.col("mid_y").between(F.col("top"), F.col("bottom")))
    inside = met.select("page_id", "mid_x", "mid_y").distinct()
    named = objects.select(F.struct("*").alias("row"), "page_id", *mid)
    return named.join(inside, ["page_id", "mid_x", "mid_y"], "left_anti").select("row.*")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text, tables) to document_id and its segments in page order: on each page the
    paragraphs first, then the texts of real tables, numbered on."""
    texts = F.concat(paragraphs(F.col("text")), F.filter(F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), table_text), lambda t: t != ""))
    each = pages.select("document_id", "page_number", _segments(texts, F.col("page_number")).alias("own"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "own")))
    return each.groupBy("document_id").agg(F.flatten(F.transform(ordered, lambda p: p["own"])).alias("segments"))


def characters(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0).cast("long"), lambda s, x: s + F.char_length(x["text"]))


def is_sparse(segments: Column, pages: Column, threshold: float = SPARSE) -> Column:
    """Whether a page has so little text on average that the pages must be pictures."""
    few = characters(segments) / F.greatest(pages, F.lit(1)) < threshold * CHARS_PER_PAGE
    return F.coalesce((F.size(segments) == 0) | few, F.lit(True))


def choose_extraction(candidates: DataFrame, threshold: float = SPARSE) -> DataFrame:
    """(document_id, is_pdf, pages, primary, ocr, llm) to document_id, method and segments: the primary ones unless a
    PDF's are sparse; then those read by OCR if half as dense as asked; then those of a language model; then whatever OCR
    or the primary method found."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    method = (
        F.when(~F.col("is_pdf") | ~is_sparse(F.col("primary"), F.col("pages"), threshold), "primary")
        .when(some(F.col("ocr")) & ~is_sparse(F.col("ocr"), F.col("pages"), threshold * 0.5), "ocr")
        .when(some(F.col("llm")), "llm")
        .when(some(F.col("ocr")), "ocr")
        .otherwise("primary")
    )
    chosen = candidates.withColumn("method", method)
    return chosen.select("document_id", "method", F.when(F.col("method") == "primary", F.col("primary")).when(F.col("method") == "ocr", F.col("ocr")).otherwise(F.col("llm")).alias("segments"))
