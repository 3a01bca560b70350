"""Merkle manifests of a table by butterfly exchange.

Leaves are dealt to aligned blocks of a power of the fanout. In each round, aligned groups of as many blocks as the fanout
swap the roots of the subtrees they stand for, and every one of them hashes the common ancestor. After the last round
each block holds its tree's root and the proof from its own root up, so nothing is handed down the tree again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotmark.llm.common import materialise

FANOUT, HEIGHT = 2, 12  # a block has fanout ** height leaves
_PROOF = "array<struct<place:int,others:array<string>>>"


def digest(*values: Column) -> Column:
    """SHA-256, as hexadecimal digits, of all values: each ``-`` if null, else its number of UTF-8 bytes, ``:``, itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` has by ``proof``: at each level its place in its run, and the digests of the run's others."""
    part = lambda s, first, n: F.array_join(F.slice(s["others"], first, n), "")
    return F.aggregate(proof, leaf, lambda own, s: F.sha2(F.concat(part(s, F.lit(1), s["place"]), own, part(s, s["place"] + 1, F.size(s["others"]))), 256))


def levels_of(leaves: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """All levels of a tree from its leaves up, to ``height`` (until one node is left, if None)."""
    levels = [leaves]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return levels


def _placed(leaves: DataFrame, group: Column, order: list[str], leaf: str, block: int) -> DataFrame:
    """``row`` (all columns of ``leaves``), its leaf, tree ``g``, block ``p`` of that tree's ``blocks``, and place there. Ranks come
    from a range partitioning and the counts of its parts, so that no tree has to be in one task."""
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("g"), F.col(leaf).alias("leaf"), F.struct("*").alias("row"))
    by = ["g", *(f"row.{c}" for c in order), "leaf"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt.withColumn("part", F.shiftright("at", 33)), "merkle-leaves")
    parts = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("g", "part", (before - F.col("first")).alias("shift"), F.ceil(F.sum("n").over(tree) / block).alias("blocks"))
    rank = F.col("at") + F.col("shift")
    return dealt.join(parts, ["g", "part"]).select("g", F.floor(rank / block).alias("p"), F.pmod(rank, F.lit(block)).cast("int").alias("place"), "blocks", "leaf", "row")


def _block_roots(placed: DataFrame, fanout: int, height: int) -> DataFrame:
    """(g, p, blocks, hash). In a tree of several blocks each block's root is at the same height, that of a last small one too."""

    def root(table: pa.Table) -> pa.Table:
        leaves = table.sort_by("place")["leaf"].to_pylist()
        blocks = table["blocks"][0].as_py()
        own = levels_of(leaves, fanout, height if blocks > 1 else None)[-1][0]
        return pa.table({"g": table["g"].slice(0, 1), "p": table["p"].slice(0, 1), "blocks": table["blocks"].slice(0, 1), "hash": [own]})

    thin = placed.select("g", "p", "place", "blocks", "leaf")
    return thin.groupBy("g", "p").applyInArrow(root, "g string, p long, blocks long, hash string")


def _butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(g, p, hash, proof): for each block its tree's root and the proof from the block's root to it.

    A tree's blocks are filled up to a power of the fanout with empty ones, so that all groups have ``fanout`` members; an empty
    block takes on the digest of the subtree that it is in like any other."""
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    widths = []
    while (fanout ** len(widths)) < most:
        widths.append(fanout ** len(widths))
    proof = F.array().cast(_PROOF)
    state = blocks.select("g", "p", "blocks", "hash", proof.alias("proof"))
    if widths:
        top = F.greatest(F.lit(0), *[F.when(F.col("blocks") > w, w).otherwise(0) for w in widths])
        images = F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda k: F.col("p") + k * F.col("top"))
        filling = state.withColumn("top", top.cast("long")).filter(F.col("p") < F.col("top")).withColumn("p", F.explode(images)).filter(F.col("p") >= F.col("blocks"))
        state = state.unionByName(filling.select("g", "p", "blocks", F.lit(None).cast("string").alias("hash"), "proof"))
    for w in widths:
        going = F.col("blocks") > w
        keys = ["g", F.when(going, F.floor(F.col("p") / (w * fanout))).otherwise(F.col("p")).alias("run"), F.when(going, F.pmod("p", F.lit(w))).otherwise(-1).alias("column")]
        met = state.groupBy(*keys).agg(F.first("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("p", "hash", "proof"))).alias("members"))
        met = met.withColumn("hashes", F.filter(F.transform("members", lambda m: m["hash"]), lambda h: h.isNotNull()))
        parent = F.when(F.size("hashes") > 0, F.sha2(F.array_join("hashes", ""), 256))
        each = met.select("g", "blocks", "hashes", parent.alias("parent"), F.posexplode("members").alias("i", "m"))
        step = F.struct(F.col("i").alias("place"), F.concat(F.slice("hashes", 1, F.col("i")), F.slice("hashes", F.col("i") + 2, F.lit(fanout))).alias("others"))
        state = each.select(
            "g",
            F.col("m.p").alias("p"),
            "blocks",
            F.when(going, F.col("parent")).otherwise(F.col("m.hash")).alias("hash"),
            F.when(going, F.concat("m.proof", F.array(step))).otherwise(F.col("m.proof")).alias("proof"),
        )
    return state.filter(F.col("p") < F.col("blocks")).select("g", "p", "hash", "proof")


def _proof_arrays(levels: list[list[str]], n: int, fanout: int, upper: list[dict]) -> pa.Array:
    """For each of ``n`` leaves the steps inside the block (all levels but the last) and then those of ``upper``."""
    nodes = [h for level in levels[:-1] for h in level] + [h for s in upper for h in s["others"]]
    places, found, valid = [], [], []
    base, leaf = 0, np.arange(n)
    for k, level in enumerate(levels[:-1]):
        own = leaf // fanout**k
        first = own - own % fanout
        run = first[:, None] + np.arange(fanout)
        places.append(own % fanout)
        valid.append((run != own[:, None]) & (run < len(level)))
        found.append(run + base)
        base += len(level)
    for s in upper:
        slots = np.arange(fanout)
        places.append(np.full(n, s["place"]))
        valid.append(np.broadcast_to(slots < len(s["others"]), (n, fanout)))
        found.append(np.broadcast_to(slots + base, (n, fanout)))
        base += len(s["others"])
    steps = len(places)
    if not steps:
        places, found, valid = [np.zeros((n, 0), int)], [np.zeros((n, 0), int)], [np.zeros((n, 0), bool)]
    place = np.stack(places, axis=1).ravel() if steps else np.zeros(0, int)
    mask = np.stack(valid, axis=1).reshape(n * steps, -1) if steps else np.zeros((0, fanout), bool)
    at = np.stack(found, axis=1).reshape(n * steps, -1)[mask] if steps else np.zeros(0, int)
    ends = np.concatenate([[0], np.cumsum(mask.sum(axis=1))]).astype(np.int32)
    others = pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes, pa.string()).take(pa.array(at, pa.int64())))
    each = pa.StructArray.from_arrays([pa.array(place, pa.int32()), others], ["place", "others"])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * steps), each)


def _proved(placed: DataFrame, state: DataFrame, fanout: int, height: int) -> DataFrame:
    """Columns of the leaves, ``root`` and ``proof``: ``state`` (g, p, root, proof) continues the proofs inside each block."""

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        levels = levels_of(rows["leaf"].to_pylist(), fanout, height if rows["blocks"][0].as_py() > 1 else None)
        proofs = _proof_arrays(levels, rows.num_rows, fanout, above["proof"][0].as_py())
        tops = [pa.array([above[c][0].as_py()] * rows.num_rows, pa.string()) for c in ("subroot", "root")]
        return pa.table([rows["row"].combine_chunks(), *tops, proofs], names=["row", "subroot", "root", "proof"])

    kind = placed.schema["row"].dataType.simpleString()
    both = placed.groupBy("g", "p").cogroup(state.groupBy("g", "p"))
    return both.applyInArrow(prove, f"row {kind}, subroot string, root string, proof {_PROOF}")


def merkle_proofs(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """(row, subroot, root, proof) of ``leaves``, ``row`` having all their columns: one tree for each value of ``group``, whose leaves
    ascend by ``order`` (nulls first; ties by the leaf), and over their roots, ordered by that value (null first,
    bytewise), one more. In a tree every ``fanout`` consecutive nodes, at the end fewer, become the SHA-256 of their
    joined digits while several remain. ``proof`` leads from the leaf to the root, see ``fold``.

    No task holds more than a block of ``fanout ** height`` leaves; the blocks of all trees exchange their roots in rounds, the
    logarithm of their number, of which each shuffles one short row a block. Repeated rows are leaves of their own, and
    an empty table has no proofs."""
    if fanout < 2 or height < 0:
        raise ValueError("fanout must be 2 or more, and height not negative")
    placed = _placed(leaves, F.col(group), order, leaf, fanout**height)
    inner = materialise(_butterfly(materialise(_block_roots(placed, fanout, height), "merkle-blocks"), fanout), "merkle-proofs")
    subroots = inner.filter("p = 0").select(F.lit(0).alias("all"), F.col("g").alias("of"), F.col("hash").alias("subroot"))
    over = _placed(subroots, F.col("all"), ["of"], "subroot", fanout**height)
    upper = materialise(_butterfly(materialise(_block_roots(over, fanout, height), "merkle-blocks"), fanout), "merkle-proofs")
    tops = _proved(over, upper.select("g", "p", F.lit("").alias("subroot"), F.col("hash").alias("root"), "proof"), fanout, height)
    tops = tops.select(F.col("row.of").alias("g"), "root", F.col("proof").alias("rest"))
    state = inner.join(tops, "g").select("g", "p", F.col("hash").alias("subroot"), "root", F.concat("proof", "rest").alias("proof"))
    return _proved(placed, materialise(state, "merkle-tops"), fanout, height)


TAMPER = 7  # documents whose crc32(doc_id) it divides are tampered with


def manifest(docs: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root and verified,
    where of some rows a copy with another n_chars is checked against the proof. Texts, however long, are hashed where
    they are read; shuffles carry digests. A null of any column has a digest of its own, and documents without a lang are
    a tree; rows that repeat an id are ordered by their leaf; other columns are ignored."""
    own = [F.col(c) for c in ("doc_id", "source", "lang")]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0
    changed = F.when(tampered & F.col("n_chars").isNotNull(), digest(*own, F.col("n_chars") + 1, F.col("text")))
    leaves = docs.select("doc_id", "lang", digest(*own, F.col("n_chars"), F.col("text")).alias("leaf"), changed.alias("tampered"))
    proved = merkle_proofs(leaves, "lang", ["doc_id"], "leaf", fanout, height)
    siblings = F.array_join(F.flatten(F.transform("proof", lambda s: s["others"])), "")
    folded = proved.select("row.doc_id", "row.leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("row.tampered", "row.leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _coded(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_coded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_CRC = """xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""
OP12_SQL = f"""WITH RECURSIVE own AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS checked FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM own),
tree AS (SELECT lang, CAST(0 AS BIGINT) AS lvl, pos, leaf AS h, n FROM ranked
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
over_tree AS (SELECT CAST(0 AS BIGINT) AS lvl, pos, subroot AS h, n FROM subs
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM over_tree WHERE n > 1 GROUP BY lvl, pos // 2, n),
heights AS (SELECT lang, max(lvl) AS height FROM tree GROUP BY lang),
steps AS (SELECT r.lang, r.pos, l.lvl, CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < (r.pos >> l.lvl) THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM ranked r JOIN heights t ON r.lang IS NOT DISTINCT FROM t.lang CROSS JOIN (SELECT unnest(range(64)) AS lvl) l LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM r.lang AND s.lvl = l.lvl AND s.pos = xor(r.pos >> l.lvl, 1) WHERE l.lvl < t.height
  UNION ALL SELECT r.lang, r.pos, 100 + l.lvl, CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < (b.pos >> l.lvl) THEN 'L' || s.h ELSE 'R' || s.h END
  FROM ranked r JOIN subs b ON r.lang IS NOT DISTINCT FROM b.lang CROSS JOIN (SELECT unnest(range(64)) AS lvl) l LEFT JOIN over_tree s ON s.lvl = l.lvl AND s.pos = xor(b.pos >> l.lvl, 1) WHERE l.lvl < (SELECT max(lvl) FROM over_tree)),
proofs AS (SELECT lang, pos, list(step ORDER BY lvl) AS steps FROM steps GROUP BY lang, pos),
folded AS (SELECT r.doc_id, r.leaf, b.subroot, (SELECT h FROM over_tree WHERE n = 1) AS root, sha256(array_to_string(list_transform(list_filter(coalesce(p.steps, []), lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(r.checked, coalesce(p.steps, [])), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root
  FROM ranked r JOIN subs b ON r.lang IS NOT DISTINCT FROM b.lang LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM r.lang AND p.pos = r.pos)
SELECT *, folded_root = root AS verified FROM folded"""
