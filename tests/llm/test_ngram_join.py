import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plotmark.llm import ngram_join
from plotmark.llm.components import connected_components


def brute(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        k = min(n, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    links, root = Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 0.79 * len(sets[a]) <= len(sets[b]) <= len(sets[a]) / 0.79 and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in sets}


def corpus():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "One"), (5, "one two three"), (6, "four words are here"), (7, "four words are here")]
    for _ in range(12):
        base = [word() for _ in range(draw.randint(6, 120))]
        for _ in range(draw.randint(1, 7)):
            own = list(base)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [256, 2])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.collect()} == brute(rows)


def test_odd_documents(odd_docs, no_docs):
    got = defaultdict(list)
    for r in ngram_join.ngram_join(odd_docs).collect():
        got[r.doc_id].append((r.class_id, r.n_links))
    assert sum(map(len, got.values())) == odd_docs.count()
    assert got[5] == [(5, 1)] and got[6] == [(5, 1)] and got[7] == [(7, 2), (7, 2)] and got[8] == [(7, 2)] and got[None] == [(None, 0)]
    assert got[0] == [(0, 0)] and got[2] == [(2, 0)]
    assert ngram_join.ngram_join(no_docs).count() == 0


def tries_of(spark, labels):
    """Rows (rep, tree, label, check) of signatures of 2 trees by 4 values."""
    rows = [(i, t, np.array(own[t * 4 : t * 4 + 4], "<u4").tobytes(), np.array(own, np.uint8).tobytes()) for i, own in labels.items() for t in range(2)]
    return spark.createDataFrame(rows, "rep long, tree int, label binary, check binary")


@pytest.mark.parametrize("light", [64, 1])
def test_prefixes_are_shortened_as_the_data_ask(spark, monkeypatch, light):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    alike = {i: [1, 2, 3, 4, 5, 6, 7, 8] for i in range(5)}
    clusters, depths = ngram_join.forest_clusters(tries_of(spark, alike), 0.6, 1, 4, 8)
    assert depths == [] and {(r.rep, r.cluster) for r in clusters.collect()} == {(i, 0) for i in range(5)}
    # Of 40 labels with two equal values many are no neighbours of those whose signatures are near; unlike ones stay apart.
    mixed = {i: [1, 2, i, 4, 5, 6, 7 + i % 2 * 200, i] for i in range(40)} | {i: [1, 100 + i, *range(i, i + 6)] for i in range(60, 64)}
    clusters, depths = ngram_join.forest_clusters(tries_of(spark, mixed), 0.7, 1, 4, 8)
    assert depths == [1] if light == 64 else len(depths) > 1 and depths == sorted(depths, reverse=True)
    got = {r.rep: r.cluster for r in clusters.collect()}
    assert got == {i: i % 2 for i in range(40)}


def test_shortening_ends_at_the_recall():
    depth = ngram_join.prefix_depth(12, 8, 0.8, 0.998)
    assert 1 - (1 - 0.8**depth) ** 12 >= 0.998 > 1 - (1 - 0.8 ** (depth + 1)) ** 12


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_recall_on_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()}
    assert sum(n for _, n in got.values()) >= 0.998 * sum(n for _, n in want.values())
    assert all(got[i][1] <= n for i, (_, n) in want.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100, 102: 100}
