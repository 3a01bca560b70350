import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from plotmark.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_documents(odd_docs, no_docs):
    assert sorted(map(tuple, exact_dedup(odd_docs).collect()), key=str) == brute(odd_docs.collect())
    assert exact_dedup(no_docs).count() == 0


def test_colliding_digests_are_told_apart_by_bytes(odd_docs):
    got = exact_dedup(odd_docs, digest=lambda t: F.substring(F.md5(t.cast("binary")), 1, 0).cast("binary"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(odd_docs.collect())


def test_smallest_id_may_stay(spark):
    got = exact_dedup(spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "doc_id int, text string"), keep="min")
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {(3, 1, False), (1, 1, True), (2, 2, True)}
