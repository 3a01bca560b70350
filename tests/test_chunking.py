import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotmark.functions.text import key_id, prefix_sums
from plotmark.operators import chunking

SCHEMA = "document_id string, address_id string, doc_version int, segments array<struct<page_number:int,paragraph_index:int,text:string>>"


def chunks(spark, segments, size, overlap):
    df = spark.createDataFrame([("d", "a", 1, segments)], SCHEMA)
    return chunking.chunk_documents(df, size, overlap).orderBy("ordinal").collect()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é\n\t", min_size=1, max_size=60), min_size=1, max_size=5), st.integers(1, 9), st.data())
def test_chunks_are_slices_that_overlap(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    segments = [(1 + i // 2, i % 2, t) for i, t in enumerate(texts)]
    whole = chunking.SEPARATOR.join(texts)
    got = chunks(spark, segments, size, overlap)
    starts = [sum(len(t) + 2 for t in texts[:i]) for i in range(len(texts))]
    assert "".join(c.text for c in got[:1]) == whole[: got[0].char_end]
    for c in got:
        assert c.text == whole[c.char_start : c.char_end]
        owner = max(i for i, s in enumerate(starts) if s <= c.char_start)
        assert (c.page_number, c.paragraph_index) == segments[owner][:2]
    for a, b in zip(got, got[1:], strict=False):
        assert a.token_count == size and b.char_start <= a.char_end
    assert got[-1].char_end == len(whole) and all(c.char_end < len(whole) for c in got[:-1])


def test_three_segments_on_two_pages(spark):
    words = lambda w, n: " ".join([w] * n)
    got = chunks(spark, [(1, 0, words("alpha", 30)), (1, 1, words("beta", 30)), (2, 0, words("gamma", 30))], 20, 5)
    assert [c.ordinal for c in got] == list(range(6)) and got == chunks(spark, [(1, 0, words("alpha", 30)), (1, 1, words("beta", 30)), (2, 0, words("gamma", 30))], 20, 5)
    assert [(c.page_number, c.paragraph_index) for c in got] == [(1, 0), (1, 0), (1, 0), (1, 1), (1, 1), (2, 0)]  # a start in a separator is the earlier segment's


def test_bad_parameters_and_no_text(spark):
    with pytest.raises(ValueError):
        chunks(spark, [(1, 0, "a")], 5, 5)
    assert chunks(spark, [], 5, 1) == [] and chunks(spark, [(1, 0, "")], 5, 1) == []


def test_prefix_sums_over_blocks(spark):
    n = 300
    got = spark.createDataFrame([(list(range(n)), [])], "x array<long>, y array<long>").select(prefix_sums(F.col("x")).alias("x"), prefix_sums(F.col("y")).alias("y")).first()
    assert got.x == [sum(range(i)) for i in range(n)] and got.y == []


def test_versions_are_replaced(spark):
    old = chunking.chunk_documents(spark.createDataFrame([("d", "a", 1, [(1, 0, "one two three")]), ("e", "a", 1, [(1, 0, "x")])], SCHEMA), 2, 0)
    new = chunking.chunk_documents(spark.createDataFrame([("d", "a", 1, [(1, 0, "four")])], SCHEMA), 2, 0)
    once = chunking.replace_version_chunks(old, new)
    assert sorted(r.text for r in once.collect()) == ["four", "x"]
    assert sorted(once.collect()) == sorted(chunking.replace_version_chunks(once, new).collect())
    assert [r.text for r in chunking.version_chunks(old, new).collect()] == ["one two", " three"]


def test_many_segments_take_time_in_proportion(spark):
    """A hundred thousand segments of one document, in the row and as rows; both find the same owners."""
    import time
    from bisect import bisect_right

    texts = [f"word{i} of some {i}" for i in range(100_000)]
    starts = [0]
    for t in texts:
        starts.append(starts[-1] + len(t) + 2)
    df = spark.createDataFrame([("d", "a", 1, [(1 + i // 10, i % 10, t) for i, t in enumerate(texts)])], SCHEMA)
    chunking.chunk_documents(df.select("document_id", "address_id", "doc_version", F.slice("segments", 1, 100).alias("segments")), 50, 10).count()
    began = time.time()
    got = chunking.chunk_documents(df, 50, 10).select("document_id", "ordinal", "char_start", "page_number", "paragraph_index").collect()
    assert time.time() - began < 60
    own = [bisect_right(starts, c.char_start) - 1 for c in got]
    assert [(c.page_number, c.paragraph_index) for c in got] == [(1 + i // 10, i % 10) for i in own] and len(got) > 9_000
    again = chunking.locate(spark.createDataFrame(got).select("document_id", "ordinal", "char_start"), chunking.segment_rows(df), "char_start")
    assert sorted((c.ordinal, c.page_number, c.paragraph_index) for c in again.collect()) == [(c.ordinal, c.page_number, c.paragraph_index) for c in got]


def test_positions_before_all_segments_and_of_unknown_documents_have_none(spark):
    segments = spark.createDataFrame([("d", 5, 1, 0), ("d", 9, 1, 1), ("d", 9, 2, 0)], "document_id string, start long, page_number int, paragraph_index int")
    asked = spark.createDataFrame([("d", 4, "x"), ("d", 5, "y"), ("d", 8, "y"), ("d", 9, "z"), ("e", 9, "z")], "document_id string, position long, note string")
    got = [(r.document_id, r.position, r.note, r.page_number, r.paragraph_index) for r in chunking.locate(asked, segments).collect()]
    assert sorted(got, key=str) == [("d", 4, "x", None, None), ("d", 5, "y", 1, 0), ("d", 8, "y", 1, 0), ("d", 9, "z", 2, 0), ("e", 9, "z", None, None)]


def test_ids_tell_nulls_and_separators_apart(spark):
    rows = [("a", None, "b"), ("a", "b", None), (None, "a", "b"), ("a", "b", ""), ("a\x1fb", "", ""), ("a", "1:b", ""), ("1:a", "b", ""), ("-", None, None), (None, None, "-")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string, c string").select(key_id(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert len(set(got)) == len(rows)


@pytest.mark.parametrize(
    ("text", "offsets", "pieces"),
    [
        ("", [], []),
        ("  ", [], []),
        ("ab cd ", [(0, 2), (3, 5)], ["ab", " cd "]),
        ("é!", [(0, 1), (0, 1), (1, 2)], ["é", "", "!"]),
        (" x", [(1, 2)], [" x"]),
    ],
)
def test_pieces_of_tokens_are_the_text(text, offsets, pieces):
    assert chunking.pieces_of(text, offsets) == pieces


def test_a_tokenizer_of_ones_own(spark):
    class Letters:
        def offsets(self, texts):
            return [[(i, i + 1) for i in range(len(t))] for t in texts]

    df = spark.createDataFrame([("d", "a", 1, [(1, 0, "abc"), (1, 1, "dé")]), ("e", "a", 1, []), ("f", "a", 1, [(1, 0, "x" * 5000)])], SCHEMA)
    got = chunking.chunk_documents(df, 4, 1, Letters).orderBy("document_id", "ordinal").collect()
    assert [(c.text, c.token_count, c.paragraph_index) for c in got if c.document_id == "d"] == [("abc\n", 4, 0), ("\n\ndé", 4, 0)]
    assert sum(c.document_id == "f" for c in got) == 1 + -(-4996 // 3) and all(c.document_id != "e" for c in got)
    assert chunking.tokens_with(df, Letters, size=10).count() == 3
