import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.normalizers import NFD, Lowercase, Sequence, StripAccents

from plotmark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
TEXTS = st.text(alphabet="ab Zé\n\t\r '.,!1２日本é ​\x00\x1c\x85😀", max_size=40)


def one(encoder, text):
    ids, counts, spans = encoder.encode(pa.array([text]))
    assert counts.tolist() == [len(ids)]
    return ids.tolist(), spans


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_tiktoken_and_offsets_cover_the_text(text):
    ids, spans = one(bpe.WordEncoder(bpe.byte_tokenizer(PATH, public_tokenizers.PATTERN), offsets=True), text)
    assert ids == PLAIN.encode_ordinary(text)
    covered = set()
    for a, b in spans.tolist():
        covered.update(range(a, b))
    assert covered == set(range(len(text)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.lists(st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "Hello", " ", "\n", "world.", "<|"]), max_size=8).map("".join)), min_size=1, max_size=5))
def test_bare_words_give_the_ids_of_the_plain_call(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, counts, _ = bpe.WordEncoder(t, bare=True).encode(pa.array(texts))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_tokenizers_that_keep_case_or_white_space_are_refused():
    with pytest.raises(ValueError):
        bpe.WordEncoder(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bare=True)


def test_round_trip_of_odd_documents(odd_docs, no_docs):
    encoded = bpe.encode_bytes(odd_docs, PATH, public_tokenizers.PATTERN)
    texts = sorted((r.text or "") for r in odd_docs.collect())
    got = bpe.decode_ids(encoded, PATH).collect()
    assert sorted(bytes(r.bytes).decode() for r in got) == texts == sorted(r.text for r in got)
    assert sum(r.n_tokens for r in got) == sum(len(PLAIN.encode_ordinary(t)) for t in texts)
    assert bpe.decode_ids(bpe.encode_bytes(no_docs, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_decoding_unknown_and_split(spark):
    half = PLAIN.encode_ordinary("😀")[:1]
    rows = spark.createDataFrame([(1, half), (2, None), (3, [10**6])], "doc_id int, ids array<int>")
    got = {r.doc_id: r for r in bpe.decode_ids(rows, PATH).collect()}
    assert "�" in got[1].text and got[2].text == "" and got[3].bytes is None


def test_op6_against_tiktoken(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.op6_bpe(spark, d).collect():
        ids = PLAIN.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a  b", " lead", "trail ", "a \n\nb"])
def test_white_space(text):
    assert one(bpe.WordEncoder(bpe.byte_tokenizer(PATH, public_tokenizers.PATTERN), offsets=True), text)[0] == PLAIN.encode_ordinary(text)


LETTERS = "abzßàöøþÿ÷×ªºµAZÀ"
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
MARKS = ".,;:!?&*%$#()[]{}<>|/\\_-~`^@+=\""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text(LETTERS, max_size=9), st.text(MARKS + "'’1é́", max_size=3)).map("".join), max_size=9).map(" ".join), min_size=1, max_size=4))
def test_simple_words_give_the_ids_of_the_plain_call(texts):
    encoder = bpe.WordEncoder(WORDS, bare=True)
    for some, kind in ((texts[:1], pa.string()), (texts, pa.large_string()), (texts[::-1], pa.string())):  # new words, some known, all known
        ids, counts, _ = encoder.encode(pa.array(some, kind))
        want = [e.ids for e in WORDS.encode_batch(some, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


class Counted:
    """A tokenizer that counts the characters that go through all of its steps."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch(texts, **options)


def test_simple_words_need_the_model_alone():
    t = Counted(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    encoder = bpe.WordEncoder(t, bare=True)
    t.chars = 0
    texts = [" ".join(f"{'Straße' * (i % 7 + 1)}{'abcdefgh'[i % 8]}{'xyz'[i % 3]}{mark}" for i in range(500)) for mark in ("", ".", "&&&")]
    ids, counts, _ = encoder.encode(pa.array(texts))
    assert t.chars == 0  # all of them before
    want = [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_the_model_alone_is_for_known_steps_only():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert bpe.SimpleWords.fit(t, ["<|endoftext|>"]) and not bpe.SimpleWords.fit(t, ["<|endoftext|>", "Hello"])
    t.normalizer = Sequence([NFD(), StripAccents(), Lowercase()])
    assert not bpe.SimpleWords.fit(t, [])
    encoder = bpe.WordEncoder(t, bare=True)
    texts = ["straße été. über&&& plain", "naïve"]
    ids, counts, _ = encoder.encode(pa.array(texts))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
