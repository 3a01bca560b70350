import hashlib
import zlib

import duckdb
import pytest

from plotmark.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(nodes, fanout):
    """(root, siblings of each node as a list of levels of (before, after)) by the definition."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, own = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for j in range(len(run)):
                for i in owners[a + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            above.append(h("".join(run)))
            own.append(sum(owners[a : a + fanout], []))
        nodes, owners = above, own
    return nodes[0], paths


def expected(rows, fanout=2):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: b"" if x is None else b"=" + x.encode())
    groups = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for x in langs}
    trees = {x: tree([leaf_of(r) for r in own], fanout) for x, own in groups.items()}
    root, tops = tree([trees[x][0] for x in langs], fanout)
    out = []
    for x, top in zip(langs, tops, strict=True):
        for r, path in zip(groups[x], trees[x][1], strict=True):
            steps = [*path, *top]
            changed = dict(r)
            if r["n_chars"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                changed["n_chars"] += 1
            node = leaf_of(changed)
            for before, after in steps:
                node = h("".join([*before, node, *after]))
            proof = h("".join("".join([*b, *a]) for b, a in steps))
            out.append((r["doc_id"], leaf_of(r), trees[x][0], root, proof, node, node == root))
    return sorted(out, key=str)


def rows_of(df):
    return [{c: r[c] for c in COLUMNS} for r in df.collect()]


def manifest(docs, **kinds):
    got = merkle.manifest(docs, **kinds).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize(("fanout", "height"), [(2, 0), (2, 2), (3, 1), (2, 12)])
def test_small_tables_of_every_shape(spark, fanout, height):
    for n in (1, 2, 3, 7, 16, 29):
        docs = spark.createDataFrame([(i * 3, f"text é {i}", [None, "de", "en", "Ä"][(i * i) % 4] if n > 3 else "en", "s", i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        assert manifest(docs, fanout=fanout, height=height) == expected(rows_of(docs), fanout)


def test_odd_and_empty(spark, odd_docs, no_docs):
    assert manifest(odd_docs, height=1) == expected(rows_of(odd_docs))
    assert manifest(no_docs) == []


def test_whole_table_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = manifest(docs, height=5)
    assert got == expected(rows_of(docs))
    assert {r[-1] for r in got} == {True, False}
    assert got == sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, sf).collect()), key=str)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(db.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.OP12_SQL})").fetchall(), key=str) == got


def test_sql_on_odd_rows(spark):
    rows = [(1, "a", None, None, None), (2, None, None, "s", 3), (None, "b", "en", "s", 4), (14, "é", "en", "s", 5), (14, "é", "en", "s", 5), (21, "", "zz", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(db.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.OP12_SQL})").fetchall(), key=str) == manifest(docs, height=1)


def test_blocks_exchange_and_no_task_holds_a_tree(spark):
    """Proofs can be folded for leaves of any table, and a wrong leaf, or one at another place, doesn't give the root."""
    from pyspark.sql import functions as F

    leaves = spark.range(1000).select("id", F.lit("x").alias("of"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    proved = merkle.merkle_proofs(leaves, "of", ["id"], fanout=4, height=2)
    assert proved.filter(merkle.fold(F.col("row.leaf"), F.col("proof")) == F.col("root")).count() == 1000
    assert proved.filter(merkle.fold(F.sha2("row.leaf", 256), F.col("proof")) == F.col("root")).count() == 0
    assert proved.select("root").distinct().count() == 1
    with pytest.raises(ValueError):
        merkle.merkle_proofs(leaves, "of", ["id"], fanout=1)
