import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plotmark.llm import packing


def check_places(rows, capacity):
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 120), max_size=8))
def test_plans_hold_every_piece_and_little_air(histogram):
    count = np.zeros(65, dtype=np.int64)
    for k, n in histogram.items():
        count[k] = n
    got = np.zeros(65, dtype=np.int64)
    bins = 0
    for contents, n in packing.plan(count, 64, rounds=30):
        assert n == 0 or sum(k * a for k, a in contents) <= 64
        bins += n
        for k, a in contents:
            got[k] += a * n
    assert (got == count).all()
    assert bins <= 1.1 * first_fit_decreasing(histogram, 64) + 1
    if histogram:
        _, bound = packing.configurations(count, 64, rounds=30)
        assert sum(k * n for k, n in histogram.items()) / 64 - 1e-9 <= bound <= bins + 1e-9


def test_the_bound_sees_what_volume_does_not():
    count = np.zeros(65, dtype=np.int64)
    count[33] = 100  # two of them never fit together
    found, bound = packing.configurations(count, 64)
    assert bound == pytest.approx(100) and sum(n for _, n in packing.plan(count, 64)) == 100


def first_fit_decreasing(histogram, capacity):
    spaces = []
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            i = next((i for i, s in enumerate(spaces) if s >= k), None)
            if i is None:
                spaces.append(capacity)
                i = len(spaces) - 1
            spaces[i] -= k
    return len(spaces)


def test_special_strings_have_the_ids_of_the_plain_call(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["hello <|endoftext|> world", "Hello <|ENDOFTEXT|> world", "a<|startoftext|>b", "plain words here"]
    got = {r.doc_id: r.ids_crc32 for r in packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert got == {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in enumerate(texts)}
    assert t.encode(texts[0], add_special_tokens=False).ids == [3306, 49407, 1002]


def test_pieces_against_the_tokenizer(spark, odd_docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(odd_docs).collect()
    check_places(rows, packing.CAPACITY)
    want = []
    for r in odd_docs.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(str(r.doc_id), i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def test_op3_packs_near_the_volume_bound(spark):
    rows = packing.op3_packing(spark, "/root/testdata/sf0.001").collect()
    bins = check_places(rows, packing.CAPACITY)
    assert bins <= 1.05 * -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_no_pieces_and_bad_lengths(spark, no_docs):
    assert packing.pack_documents(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 3000)], "doc_id int, piece int, length long"))


def test_letters_whose_lower_case_grows(spark):
    """And all letters that normal form or lower case changes: alone, before marks and inside words."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [c for c in map(chr, range(128, 0x110000)) if not "\ud800" <= c <= "\udfff" and c.isalpha() and (len(c.lower()) > 1 or not unicodedata.normalize("NFC", c).isalpha() or (ord(c) % 97 == 0))]
    assert "İ" in odd
    texts = [f"{c}{mark} x{c}{mark} {c}x{mark} a{c}b{mark}{c}" for c in odd for mark in (".", ",", "")] + ["Seferden önce T.C. ve ALİ. geldi", "ALİ, ALİ. ali."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    want = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in enumerate(texts)}
    assert [texts[i] for i in want if got[i] != want[i]] == []


@pytest.mark.parametrize(("full", "parts"), [(20_000, 2), (30_000, 3), (20_000, 4)])
def test_cut_sequences_are_put_together_again(full, parts):
    rng = np.random.default_rng(parts)
    count = np.zeros(2049, dtype=np.int64)
    for _ in range(full):
        cuts = np.sort(rng.choice(np.arange(1, 2048), parts - 1, replace=False))
        np.add.at(count, np.diff([0, *cuts, 2048]), 1)
    groups = packing.plan(count, 2048)
    got = np.zeros(2049, dtype=np.int64)
    for contents, n in groups:
        assert not n or sum(k * a for k, a in contents) <= 2048
        for k, a in contents:
            got[k] += a * n
    assert (got == count).all()
    assert full <= sum(n for _, n in groups) <= 1.01 * full and full * 0.98 <= packing.lower_bound(count, 2048) <= full + 1e-6


def test_a_bound_where_volume_says_little():
    count = np.zeros(2049, dtype=np.int64)
    count[700:1000] = 100
    assert packing.lower_bound(count, 2048) == pytest.approx(15_000) and sum(n for _, n in packing.plan(count, 2048)) == 15_000
