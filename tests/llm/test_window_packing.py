import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plotmark.llm import window_packing as wp

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")


def check(rows, texts, plain, capacity):
    """Every id of every document is in one piece, with its checksum, and sequences are gapless and unpadded."""
    own, used = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    assert set(own) == set(texts)
    for i, text in texts.items():
        ids, at = plain(text or ""), 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return len(used)


def test_whole_table_against_the_plain_call(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = wp.op11_window_packing(spark, "/root/testdata/sf0.01").collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()}, plain, wp.CAPACITY)
    total = sum(r.length for r in rows)
    assert n <= total // wp.CAPACITY + 11 * docs.rdd.getNumPartitions()


def test_odd_documents(spark, plain, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(["Hi <|endoftext|> there", "don't stop. I'll, we'Ve!", "a\u00a0 b\t\tc  \n\n d ", "ALİ. é́. ǅ, x\x00y", "  ", "\n", "word.\nword,word;word "])]
    got = wp.pack_windows(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), PATH, 64).collect()
    check(got, dict(rows), plain, 64)
    unique = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check(wp.pack_windows(unique, PATH, 256, max_open=2).collect(), {r.doc_id: r.text for r in unique.collect()}, plain, 256)
    everything = wp.pack_windows(odd_docs, PATH).collect()
    assert sum(r.length for r in everything) == sum(len(plain(r.text or "")) for r in odd_docs.collect())
    assert {r.doc_id for r in everything} == {r.doc_id for r in odd_docs.collect()}
    assert wp.pack_windows(no_docs, PATH).collect() == []


def test_encoder_equals_the_plain_call_on_random_strings(plain):
    import pyarrow as pa

    draw = random.Random(5)
    letters = ["a", "Be", "é", "ß", "İ", "ǆ", "ʼ", "日本", "😀", ".", ",", "!", "'s", "'ll", "1", "²", " ", " ", " ", "\n", "  ", "\t", "\u00a0", "\u0301", "<", "<|endoftext|>", "\x00"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(20_000)]
    encoder = wp.PieceEncoder(Tokenizer.from_file(PATH))
    for i in range(0, len(texts), 2_500):  # words learnt before are met again
        part = texts[i : i + 2_500]
        ids, counts, _ = encoder.encode(pa.array(part))
        ends = np.cumsum(counts)
        for text, lo, hi in zip(part, ends - counts, ends, strict=True):
            assert ids[lo:hi].tolist() == plain(text)[:-1].tolist(), repr(text)


def test_every_placement_has_the_smallest_sum_of_squares():
    draw = random.Random(3)
    windows = wp.Windows(32, max_open=10_000)
    for i in range(2_000):
        size = draw.choice([3, 5, 8, 13, 21, 31])
        before = windows.count.copy()
        tried = {}
        for level in [0, *np.flatnonzero(before[: 32 - size + 1])]:
            after = before.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 32
            tried[level] = int((after**2).sum())
        assert tried[windows.best_level(size)] == min(tried.values())
        windows.add(i, np.zeros(size, np.int32))
        assert windows.open == windows.count.sum() == sum(map(len, windows.at))


def test_open_windows_stay_bounded_and_good_mixtures_need_few_cuts():
    windows = wp.Windows(2048, max_open=16)
    for i in range(500):
        windows.add(i, np.zeros(1500, np.int32))
        assert windows.open <= 16
    windows.finish()
    assert sum(len(p[2]) for w in windows.full for p in w) == 500 * 1500
    windows = wp.Windows(2048)
    draw = random.Random(1)
    for i in range(20_000):
        windows.add(i, np.zeros(draw.choice([512, 1024, 1536]), np.int32))
    windows.finish()
    assert sum(len(w) for w in windows.full) <= 20_000 + 100  # pieces: hardly a document is cut
