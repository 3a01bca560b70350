"""Lexemes, postings and cover-density ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmark.functions.text import let
from plotmark.sources.storage import stored

WORD = r"[0-9]+\.[0-9]+|[\p{L}\p{N}]+"
_HOST = r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}"
#: Kinds of words, tried in this order: e-mail addresses, addresses of pages, hosts, versions, numbers with an exponent, words that begin
#: with a digit, signed numbers, compounds with hyphens, words. Without looks ahead or behind, so all engines agree.
KINDS = "|".join(
    (
        rf"[a-z0-9._%+-]+@{_HOST}",
        rf"(?:[a-z]+://)?{_HOST}(?::[0-9]+)?/(?:[^ \t\n\r<>\"]*[^ \t\n\r<>\".,;:!?)])?",
        rf"(?:[a-z]+://)?{_HOST}(?::[0-9]+)?",
        r"[0-9]+(?:\.[0-9]+){2,}",
        r"[-+]?[0-9]+(?:\.[0-9]+)?e[-+]?[0-9]+",
        r"[0-9]+\p{L}[\p{L}\p{N}]*",
        r"[-+]?[0-9]+(?:\.[0-9]+)?",
        r"\p{L}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)+",
        r"[\p{L}\p{N}]+",
    )
)
#: The English stop words of the Snowball project.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they "
    "them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does "
    "did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
CONFIGS = ("simple", "english_nostem", "english")
UNLABELLED = 0.1  # weight of a lexeme


def words(text: Column, kinds: bool = False) -> Column:
    """Words in lower case: runs of letters and digits, and decimals. With ``kinds``, as full-text parsers for English tell them apart:
    e-mail addresses, hosts, versions and signed numbers are one word each; the address of a page is followed by its host and
    its path, and a compound by its parts, each at a place of its own; what names a protocol is none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    if not kinds:
        return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))

    def parts(word: Column) -> Column:
        bare = F.regexp_replace(word, "^[a-z]+://", "")
        host = F.substring_index(bare, "/", 1)
        path = F.substring(bare, F.char_length(host) + 1, F.char_length(bare))
        compound = F.rlike(word, F.lit(r"^\p{L}")) & F.contains(word, F.lit("-")) & ~F.contains(word, F.lit("."))
        return (
            F.when(F.contains(word, F.lit("@")), F.array(word))
            .when(F.contains(bare, F.lit("/")), F.array(bare, host, path))
            .when(compound, F.concat(F.array(word), F.split(word, "-")))
            .otherwise(F.array(bare))
        )

    return F.flatten(F.transform(F.regexp_extract_all(lower, F.lit(KINDS), F.lit(0)), parts))


class PorterStemmer:
    """Porter's second English stemmer, from its published rules."""

    #: The rules' suffixes and exceptions.
    VOWELS = "aeiouy"
    EXCEPTIONS = {
        "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
        "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
        "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
    }
    AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
    STEP_2 = {
        "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
        "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
        "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
    }
    STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
    STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

    def _regions(self, w: str) -> tuple[int, int]:
        m = re.match("gener|commun|arsen", w)
        r1 = m.end() if m else self._after(w, 0)
        return r1, self._after(w, r1)

    def _after(self, w: str, start: int) -> int:
        m = re.compile(f"[{self.VOWELS}][^{self.VOWELS}]").search(w, start)
        return m.end() if m else len(w)

    def _short_end(self, w: str) -> bool:
        return bool(re.search(f"(^[{self.VOWELS}][^{self.VOWELS}]|[^{self.VOWELS}][{self.VOWELS}][^{self.VOWELS}wxY])$", w))

    def stem(self, word: str) -> str:
        if len(word) <= 2 or not word.isascii() or not word.isalpha():
            return word
        if word in self.EXCEPTIONS:
            return self.EXCEPTIONS[word]
        w = re.sub(f"(?<=[{self.VOWELS}])y|^y", "Y", word)
        r1, r2 = self._regions(w)
        w = self._step_1a(w)
        if w in self.AFTER_1A:
            return w
        w = self._step_1b(w, r1)
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in self.VOWELS:
            w = w[:-1] + "i"
        w = self._step_2(w, r1)
        w = self._step_3(w, r1, r2)
        w = self._step_4(w, r2)
        if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not self._short_end(w[:-1])) or w.endswith("ll") and len(w) > r2:
            w = w[:-1]
        return w.lower()

    def _step_1a(self, w: str) -> str:
        if w.endswith("sses"):
            return w[:-2]
        if w.endswith(("ied", "ies")):
            return w[:-2] if len(w) > 4 else w[:-1]
        if w.endswith("s") and not w.endswith(("us", "ss")) and any(c in self.VOWELS for c in w[:-2]):
            return w[:-1]
        return w

    def _step_1b(self, w: str, r1: int) -> str:
        for suffix in ("eedly", "eed"):
            if w.endswith(suffix):
                return w[: -len(suffix)] + "ee" if len(w) - len(suffix) >= r1 else w
        for suffix in ("ingly", "edly", "ing", "ed"):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if not any(c in self.VOWELS for c in stem):
                    return w
                if stem.endswith(("at", "bl", "iz")):
                    return stem + "e"
                if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", stem):
                    return stem[:-1]
                return stem + "e" if self._short_end(stem) and r1 >= len(stem) else stem
        return w

    def _step_2(self, w: str, r1: int) -> str:
        for suffix, new in self.STEP_2.items():
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                fits = len(stem) >= r1 and (suffix != "ogi" or stem.endswith("l")) and (suffix != "li" or stem[-1:] in tuple("cdeghkmnrt"))
                return stem + new if fits else w
        return w

    def _step_3(self, w: str, r1: int, r2: int) -> str:
        for suffix, new in self.STEP_3.items():
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                return stem + new if len(stem) >= (r2 if suffix == "ative" else r1) else w
        return w

    def _step_4(self, w: str, r2: int) -> str:
        for suffix in self.STEP_4:
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                return stem if len(stem) >= r2 and (suffix != "ion" or stem.endswith(("s", "t"))) else w
        return w


@lru_cache(maxsize=500_000)
def _stem(word: str) -> str:
    return PorterStemmer().stem(word)


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's words as their stems; of a batch's words each distinct one is stemmed once."""
    for b in batches:
        lists = b.column(b.num_columns - 1)
        words = lists.flatten().dictionary_encode()
        stems = pa.array([_stem(w) for w in words.dictionary.to_pylist()], pa.string())
        offsets = pc.subtract(lists.offsets, lists.offsets[0])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, stems.take(words.indices))], b.schema.names)


def _positions(words: Column) -> Column:
    """(lexeme, positions) of the distinct ones of an array of words, nulls left out: words and places are sorted together once, and cut
    where the word changes."""

    def runs(pairs: Column) -> Column:
        begins = F.filter(F.transform(pairs, lambda x, i: F.when((i == 0) | (F.get(pairs, i - 1)["word"] != x["word"]), i)), lambda i: i.isNotNull())

        def cut(first: Column) -> Column:
            ends = F.concat(F.slice(first, 2, F.size(first)), F.array(F.size(pairs)))
            own = lambda a, b: F.struct(F.get(pairs, a)["word"].alias("lexeme"), F.transform(F.slice(pairs, a + 1, b - a), lambda x: x["at"]).alias("positions"))
            return F.zip_with(first, ends, own)

        return let(begins, cut)

    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (i + 1).alias("at")))
    return let(F.sort_array(F.filter(placed, lambda x: x["word"].isNotNull())), runs)


def lexemes(texts: DataFrame, config: str = "english", id_cols: tuple[str, ...] = ("chunk_id",), text_col: str = "text", kinds: bool = False, merged: bool = True) -> DataFrame:
    """(ids, lexeme, positions): where each lexeme of a text stands, counted from 1 over all words, stop words too.

    ``simple`` keeps words as they are, ``english_nostem`` leaves out stop words, ``english`` also stems. ``kinds`` tells kinds of words
    apart, see ``words``. Null text has no lexemes. All happens within the row; rows with the same ids are then put together, in one
    shuffle of all lexemes, unless ``merged`` is false, as it may be where ids are unique."""
    if config not in CONFIGS:
        raise ValueError(f"config is one of {CONFIGS}")
    own = texts.select(*id_cols, words(F.col(text_col), kinds).alias("words"))
    if config != "simple":
        own = own.withColumn("words", F.transform("words", lambda w: F.when(~w.isin(STOP_WORDS), w)))
    if config == "english":
        own = own.mapInArrow(_stemmed, own.schema)
    # An outer one: of an inner one Spark would infer a filter that computes the positions again.
    found = own.select(*id_cols, F.inline_outer(_positions(F.col("words")))).filter("lexeme is not null")
    if not merged:
        return found
    return found.groupBy(*id_cols, "lexeme").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def query_lexemes(queries: DataFrame, config: str = "english", kinds: bool = False) -> DataFrame:
    """(query_id, address_id, lexeme, needed): the distinct lexemes of each query, and how many it has. ``kinds`` as the postings' own."""
    own = lexemes(queries, config, ("query_id", "address_id"), "query_text", kinds).drop("positions")
    needed = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    return own.join(needed, "query_id")


def match_all(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, chunk_id, needed, hits): chunks of the query's own address that have all its lexemes; hits are
    (position, lexeme) in order. Postings of other lexemes end at the join, before anything is grouped; ``wanted`` is written as a table
    first, so that its size is known and a small one goes to the postings instead of these being dealt out."""
    joined = postings.join(stored(wanted, "wanted"), ["address_id", "lexeme"])
    hits = F.transform("positions", lambda p: F.struct(p.alias("position"), F.col("lexeme").alias("lexeme")))
    grouped = joined.select("query_id", "chunk_id", "needed", "lexeme", hits.alias("hits")).groupBy("query_id", "chunk_id", "needed")
    found = grouped.agg(F.size(F.collect_set("lexeme")).alias("found"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return found.filter("found = needed").drop("found")


def cover_density(hits: Column) -> Column:
    """Rank of one text by its (position, lexeme) in order: each shortest interval with all lexemes adds the weight over 1 plus the
    words in it that match nothing; the next one starts behind its first word. One pass over the hits, which keeps where each
    lexeme was met last."""

    def fold(own: Column, names: Column) -> Column:
        def meet(state: Column, hit: Column) -> Column:
            last = F.transform(state["last"], lambda v, j: F.when(F.get(names, j) == hit["lexeme"], hit["at"]).otherwise(v))
            return let(last, lambda now: let(F.array_min(now), lambda start: add(state, hit, now, start)))

        def add(state: Column, hit: Column, last: Column, start: Column) -> Column:
            whole = start >= state["first"]
            matched = hit["at"] - start
            noise = hit["position"] - F.get(own, start)["position"] - matched
            more = F.lit(UNLABELLED) / (F.when(noise >= 0, noise).otherwise(F.floor(matched / 2)) + 1)
            return F.struct(last.alias("last"), F.when(whole, start + 1).otherwise(state["first"]).alias("first"), F.when(whole, state["score"] + more).otherwise(state["score"]).alias("score"))

        before = F.struct(F.transform(names, lambda _: F.lit(-1)).alias("last"), F.lit(0).alias("first"), F.lit(0.0).alias("score"))
        placed = F.transform(own, lambda h, i: F.struct(i.alias("at"), h["position"].alias("position"), h["lexeme"].alias("lexeme")))
        return F.aggregate(placed, before, meet, lambda state: state["score"])

    return let(hits, lambda own: let(F.array_distinct(F.transform(own, lambda h: h["lexeme"])), lambda names: fold(own, names)))


def rank_matches(matches: DataFrame) -> DataFrame:
    """(query_id, chunk_id, text_rank) by cover density; where a query has one lexeme, every match is an interval."""
    rank = F.when(F.col("needed") == 1, F.size("hits") * F.lit(UNLABELLED)).otherwise(cover_density(F.col("hits")))
    return matches.select("query_id", "chunk_id", rank.alias("text_rank"))
