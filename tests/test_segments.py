import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plotmark.operators import segments


def values(spark, text, fn):
    return [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("s")).first().s]


def test_paragraphs_of_plain_text(spark):
    assert values(spark, "para one here.\n\npara two here.", segments.paragraph_segments) == [(1, 0, "para one here."), (1, 1, "para two here.")]
    assert values(spark, " a \r\n\r\n \n\n b \n", segments.paragraph_segments) == [(1, 0, "a"), (1, 1, "b")]
    assert values(spark, None, segments.paragraph_segments) == []


def test_bytes_become_text(spark):
    data = b"ok \xff\xc3\x28 \xe2\x82\xac \xf0\x9f\x98"
    assert spark.createDataFrame([(bytearray(data),)], "d binary").select(segments.decode_bytes(F.col("d")).alias("t")).first().t == data.decode("utf-8", "replace")


def test_page_markers(spark):
    text = "before\n\nmore\n  ---PAGE 4---  \nfour\r\n---PAGE\t12---\n\n\n---PAGE x---\n---page 3---"
    assert values(spark, text, segments.page_marker_segments) == [(1, 0, "before"), (1, 1, "more"), (4, 0, "four"), (12, 0, "---PAGE x---\n---page 3---")]
    assert values(spark, "---PAGE 2---", segments.page_marker_segments) == []


def test_table_text(spark):
    cases = [
        ([["a", " b\n c "], [None, ""], ["d", None]], "a | b c\nd | "),
        ([["a"], ["b"]], ""),
        ([["a", "b"]], ""),
        ([["a", "b"], [" ", None]], ""),
        ([["a"], ["b", "c"]], "a\nb | c"),
        ([], ""),
        (None, ""),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<array<string>>")
    assert [r.t for r in df.select("i", segments.table_text(F.col("c")).alias("t")).orderBy("i").collect()] == [t for _, t in cases]


def test_objects_in_real_tables_go(spark):
    objects = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0, "in"), (1, 9.0, 11.0, 0.0, 2.0, "edge"), (1, 11.0, 13.0, 0.0, 2.0, "out"), (2, 0.0, 2.0, 0.0, 2.0, "other page")], "page_id int, x0 double, x1 double, top double, bottom double, text string")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, [["a", "b"], ["c", "d"]]), (2, 0.0, 0.0, 10.0, 10.0, [["frame"]])], "page_id int, x0 double, top double, x1 double, bottom double, cells array<array<string>>")
    assert {r.text for r in segments.exclude_in_tables(objects, boxes).collect()} == {"out", "other page"}


def test_pages_are_assembled(spark):
    pages = spark.createDataFrame([("d", 2, "c", [[["x"]]]), ("d", 1, "a\n\nb", [[["1", "2"], ["3", "4"]]]), ("e", 1, None, None)], "document_id string, page_number int, text string, tables array<array<array<string>>>")
    got = {r.document_id: [tuple(s) for s in r.segments] for r in segments.assemble_pages(pages).collect()}
    assert got == {"d": [(1, 0, "a"), (1, 1, "b"), (1, 2, "1 | 2\n3 | 4"), (2, 0, "c")], "e": []}


def test_extraction_choice(spark):
    seg = lambda n: [(1, 0, "x" * n)] if n else []
    rows = [("text", False, 1, seg(1), seg(500), None), ("dense", True, 1, seg(100), seg(500), None), ("ocr", True, 1, seg(99), seg(50), seg(9)), ("llm", True, 1, seg(99), seg(49), seg(9)), ("weak", True, 1, seg(99), seg(49), []), ("none", True, 2, seg(199), None, None)]
    s = "array<struct<page_number:int,paragraph_index:int,text:string>>"
    df = spark.createDataFrame(rows, f"document_id string, is_pdf boolean, pages int, primary {s}, ocr {s}, llm {s}")
    assert {r.document_id: r.method for r in segments.choose_extraction(df).collect()} == {"text": "primary", "dense": "primary", "ocr": "ocr", "llm": "llm", "weak": "ocr", "none": "primary"}


def test_format(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1"), "text/plain"), (bytearray(b"x"), "application/pdf"), (bytearray(b"x"), None), (None, None)], "data binary, content_type string")
    pdf, text = segments.split_by_format(df)
    assert (pdf.count(), text.count()) == (2, 2)


def test_a_crowded_page_against_brute_force(spark):
    """A hundred thousand objects and ten thousand boxes on one page, small and large ones."""
    draw = np.random.default_rng(4)
    at, span = draw.uniform(-5_000, 5_000, (10_000, 2)), 2.0 ** draw.uniform(-1, 4, (10_000, 2))
    span[:3] = 700
    cells = [["a", "b"], ["c", "d"]]
    boxes = [("p", float(x), float(y), float(x + w), float(y + h), cells) for (x, y), (w, h) in zip(at, span, strict=True)]
    boxes += [("p", -9e3, -9e3, 9e3, 9e3, [["a"]]), ("p", 5.0, 5.0, 4.0, 9.0, cells), ("q", -9e3, -9e3, 9e3, 9e3, cells), ("p", None, 0.0, 1.0, 1.0, cells)]
    mids = draw.uniform(-5_100, 5_100, (100_000, 2))
    mids[:200] = at[:200] + span[:200] * [1, 0]  # on an edge
    rows = spark.createDataFrame(pd.DataFrame({"page_id": "p", "x0": mids[:, 0] - 1, "x1": mids[:, 0] + 1, "top": mids[:, 1] - 2, "bottom": mids[:, 1] + 2, "n": np.arange(100_000)}))
    other = spark.createDataFrame([("r", 0.0, 1.0, 0.0, 1.0, -1), (None, 0.0, 1.0, 0.0, 1.0, -2), ("p", None, 1.0, 0.0, 1.0, -3), ("q", 0.0, 1.0, 0.0, 1.0, -4)], rows.schema)
    got = {r.n for r in segments.exclude_in_tables(rows.union(other), spark.createDataFrame(boxes, "page_id string, x0 double, top double, x1 double, bottom double, cells array<array<string>>")).collect()}
    x, y = (mids[:, 0] - 1 + mids[:, 0] + 1) / 2, (mids[:, 1] - 2 + mids[:, 1] + 2) / 2
    inside = np.zeros(100_000, bool)
    for (a, b), (w, h) in zip(at, span, strict=True):
        inside |= (x >= a) & (x <= a + w) & (y >= b) & (y <= b + h)
    assert 1_000 < inside.sum() < 99_000 and got == set(np.flatnonzero(~inside).tolist()) | {-1, -2, -3}
