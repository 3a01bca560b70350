"""N-gram Jaccard join: MinHash LSH forest, then exact verification of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmark.llm.common import docs_of, key_runs, materialise
from plotmark.llm.components import connected_components

WORDS, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, RECALL = 12, 8, 0.998
NEIGHBOURS = 2  # that a label is compared with before it in the sorted trie
LIGHT = 64  # comparisons a label that are taken on at once; where shorter prefixes ask more, longer ones come first
BLOCK, BLOCK_SHINGLES = 512, 800_000  # members and shingles of which about so many are compared together
SLICE = 4096  # shingles that a verification multiplies at once

_U = np.uint64


def prefix_depth(trees: int, max_depth: int, threshold: float, recall: float) -> int:
    """The depth at which shortening ends: a pair at the threshold shares a prefix of that many values in some tree with
    probability ``recall``."""
    for depth in range(max_depth, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return x[:n] | _U(1), x[n:]


def shingles_of(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; fewer words than that are one shingle."""
    words = words.astype(np.int64).view(_U)
    if not len(words):
        return words
    k = min(n, len(words))
    a, _ = _constants(n)
    total = np.full(len(words) - k + 1, k, dtype=_U)
    for i in range(k):
        total = total + _mix(words[i : len(words) - k + 1 + i] * a[i])
        total = _mix(total * _U(0x9E3779B97F4A7C15))
    return np.unique(total)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words between white space."""
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        yield values[a:b]


def sketches(docs: DataFrame, n: int, trees: int, depth: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, how many distinct shingles it has, a 128-bit hash of their set (k1, k2), the MinHash
    signature (``trees`` labels of ``depth`` 32-bit values) and a byte of each value, to estimate similarities by.
    Documents without words have no shingles and null keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants(trees * depth)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sets = [shingles_of(w, n) for w in _lists(part.column(1))]
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                keys = np.zeros((2, len(sets)), dtype=_U)
                signatures = np.zeros((len(sets), trees * depth), dtype=np.uint32)
                if len(some):
                    flat = np.concatenate(sets)
                    starts = (np.cumsum(sizes) - sizes)[some]
                    for i, seed in enumerate((0x51ED270B, 0xA0761D64)):
                        keys[i, some] = np.add.reduceat(_mix(flat ^ _U(seed)), starts)
                    for i in range(trees * depth):
                        signatures[some, i] = np.minimum.reduceat((flat * a[i] + b[i]) >> _U(32), starts)
                none = sizes == 0
                signed = pa.array([None if x else s.tobytes() for x, s in zip(none, signatures, strict=True)], type=pa.binary())
                check = pa.array([None if x else s.tobytes() for x, s in zip(none, signatures.astype(np.uint8), strict=True)], type=pa.binary())
                k1, k2 = (pa.array(k.view(np.int64), mask=none) for k in keys)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), k1, k2, signed, check], ["doc_id", "shingles", "k1", "k2", "signature", "check"])

    rows = docs_of(docs, id_col, text_col).select("doc_id", word_hashes(F.col("text")).alias("words"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sketch, f"doc_id {kind}, shingles int, k1 long, k2 long, signature binary, check binary")


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each member's component; ``linked`` is a symmetric matrix."""
    root = ids.copy()
    while True:
        low = np.where(linked, root[None, :], root[:, None]).min(axis=1)
        low = np.minimum(low, root)
        if (low == root).all():
            return root
        root = low


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equally long binaries as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _prefix(depth: int) -> Column:
    """The trie node of a label at ``depth``."""
    return F.xxhash64("tree", F.substring("label", 1, 4 * depth))


def _neighbour_edges(tries: DataFrame, depth: int, slots: int, least: float, kind: str) -> DataFrame:
    """(a, b): labels next to each other in a sorted trie, which are those with the longest common prefixes, if these have
    ``depth`` values and the signatures agree in a share of ``least``; a run of such labels has one edge from each to
    its smallest. A range partitioning deals out the sorted tries, so
    that no task gets more than others however many labels are alike."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), np.uint32)[:, :depth], _matrix(batch.column(3), np.uint8)]
            if held:
                own = [np.concatenate(x) for x in zip(held, own, strict=True)]
            ids, tree, label, check = own
            near = []
            for back in range(1, min(NEIGHBOURS, len(ids) - 1) + 1):
                same = np.flatnonzero((tree[back:] == tree[:-back]) & (label[back:] == label[:-back]).all(axis=1)) + back
                near.append(same[(check[same] == check[same - back]).sum(axis=1) >= least * slots])
            held = [x[-NEIGHBOURS:] for x in own]
            if not near:
                continue
            starts = np.setdiff1d(np.arange(len(ids)), near[0])
            run = np.searchsorted(starts, np.arange(len(ids)), side="right") - 1
            lowest = np.minimum.reduceat(ids, starts)[run]
            high, low = [ids], [lowest]
            for back, at in enumerate(near[1:], 2):
                high.append(lowest[at])
                low.append(lowest[at - back])
            high, low = np.concatenate(high), np.concatenate(low)
            yield pa.RecordBatch.from_arrays([pa.array(high[high != low]), pa.array(low[high != low])], ["a", "b"])

    order = ("tree", "label", "rep")
    rows = tries.select("rep", "tree", "label", "check").repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(compare, f"a {kind}, b {kind}")


def _pairs_of_parts(rows: DataFrame, key: str, part: Column, others: Column, *columns: str) -> DataFrame:
    """Rows of a group ``key``, each once for every pair of its own ``part`` with one of the first ``others`` parts of the
    group: block, same (a part with itself), part and ``columns``, sorted by block."""
    each = rows.select(key, part.cast("int").alias("part"), *columns, F.explode(F.sequence(F.lit(0), others.cast("int") - 1)).alias("other"))
    block = F.xxhash64(key, F.least("part", "other"), F.greatest("part", "other"))
    each = each.select(block.alias("block"), (F.col("part") == F.col("other")).alias("same"), "part", *columns)
    return each.repartition("block").sortWithinPartitions("block")


def _level_blocks(active: DataFrame, mixed: DataFrame, depth: int) -> DataFrame:
    """The members of the nodes at ``depth`` that hold several components, in blocks: those outside a node's largest
    component meet one another and all of it, but it doesn't meet itself."""
    own = mixed.filter(F.col("depth") == depth).select("node", "top", "m")
    rows = active.withColumn("node", _prefix(depth)).join(own, "node")
    strays, largest = (F.ceil(n / BLOCK) for n in (F.col("m") - F.col("top.n"), F.col("top.n")))
    at = lambda n: F.pmod(F.xxhash64("rep"), n)
    in_top = F.col("comp") == F.col("top.comp")
    return _pairs_of_parts(rows, "node", F.when(in_top, strays + at(largest)).otherwise(at(strays)), F.when(in_top, strays).otherwise(strays + largest), "comp", "check")


def _level_edges(nodes: DataFrame, slots: int, least: float, kind: str) -> DataFrame:
    """(a, b): components with members in one trie node whose signatures agree in a share of ``least``, linked to the
    smallest that they are connected to in a block."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, "block"):
            comp, check = run.column("comp").to_numpy(), _matrix(run.column("check").combine_chunks(), np.uint8)
            agree = np.zeros((len(comp), len(comp)), dtype=np.uint16)
            for i in range(slots):
                agree += check[:, i][:, None] == check[:, i][None, :]
            root = _roots((agree >= least * slots) | (comp[:, None] == comp[None, :]), comp)
            pairs = np.unique(np.stack([comp, root])[:, root != comp], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return nodes.mapInArrow(compare, f"a {kind}, b {kind}")


def forest_clusters(tries: DataFrame, least: float, floor: int, max_depth: int, slots: int) -> tuple[DataFrame, list[int]]:
    """Sorted prefix tries, rows (rep, tree, label, check), to clusters of candidates: (rep, cluster) for the members of
    those of two or more, and the depths to which prefixes were shortened.

    First every label meets its neighbours in the sorted trie, those with its longest prefixes. Then matched prefixes are
    shortened until ``floor``, as fast as the data allow: each time to the shortest at which the nodes that still hold
    several components ask for no more than ``LIGHT`` comparisons a label, or else to the longest that has such nodes. So
    a large group of near copies is put together by long prefixes and costs nothing at shorter ones, and shortening ends
    early where no node of depth ``floor`` holds several components. Any two labels that share a node of that depth end in
    one cluster or have been compared by signature.
    """
    kind = tries.schema["rep"].dataType.simpleString()
    linked = connected_components(_neighbour_edges(tries, floor, slots, least, kind))
    comps = materialise(linked.select(F.col("id").alias("rep"), F.col("root").alias("comp")), "comps")
    active = materialise(tries.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "active")
    visited, below = [], max_depth + 1
    while below > floor:
        depths = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("node")) for d in range(floor, below)])
        held = active.select("comp", F.inline(depths)).groupBy("depth", "node", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("depth", "node")
        held = held.agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("m"))
        mixed = materialise(held.filter("m > top.n"), "mixed")
        asked = {r["depth"]: r for r in mixed.groupBy("depth").agg(F.sum("m").alias("m"), F.sum(F.col("m") * (F.col("m") - F.col("top.n"))).alias("n")).collect()}
        if not asked:
            break
        depth = min((d for d, r in asked.items() if r["n"] <= LIGHT * r["m"]), default=max(asked))
        visited.append(depth)
        edges = _level_edges(_level_blocks(active, mixed, depth), slots, least, kind)
        moved = connected_components(edges).select(F.col("id").alias("comp"), F.col("root").alias("to"))
        comps = comps.unionByName(moved.select(F.col("comp").alias("rep"), "comp"))
        comps = materialise(comps.join(moved, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "comps")
        if depth > floor:
            # What shares no node of the last depth with another component is settled.
            last = mixed.filter(F.col("depth") == floor).select("node")
            active = active.withColumn("node", _prefix(floor)).join(last, "node", "left_semi").join(moved, "comp", "left")
            active = materialise(active.withColumn("comp", F.coalesce("to", "comp")).select(*tries.columns, "comp"), "active")
        below = depth
    clusters = comps.select("rep", F.col("comp").alias("cluster"))
    return clusters.union(clusters.select(F.col("cluster").alias("rep"), "cluster")).distinct(), visited


def _verified(blocks: DataFrame, threshold: float, n: int, kind: str) -> DataFrame:
    """Rows (block, same, rep, part, size, words), sorted by block, to (rep, links, root): the number of documents of
    this block that ``rep`` is linked with, and the smallest rep of its component in the block."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, "block"):
            ids, first = np.unique(run.column("rep").to_numpy(), return_index=True)
            part, size = (run.column(c).to_numpy()[first] for c in ("part", "size"))
            words = list(_lists(run.column("words").combine_chunks()))
            sets = [shingles_of(words[i], n) for i in first]
            sizes = np.array([len(s) for s in sets])
            values, columns, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            rows = np.repeat(np.arange(len(sets)), sizes)
            shared = often[columns] > 1  # a shingle of one document alone is in no intersection
            rows, columns = rows[shared], (np.cumsum(often > 1) - 1)[columns[shared]]
            order = np.argsort(columns, kind="stable")
            rows, columns = rows[order], columns[order]
            both = np.zeros((len(sets), len(sets)), dtype=np.float32)
            for lo in range(0, int((often > 1).sum()), SLICE):
                a, b = np.searchsorted(columns, (lo, lo + SLICE))
                present = np.zeros((len(sets), SLICE), dtype=np.float32)
                present[rows[a:b], columns[a:b] - lo] = 1
                both += present @ present.T
            union = sizes[:, None] + sizes[None, :] - both
            linked = both >= threshold * union - 1e-9
            if not run.column("same")[0].as_py():
                linked &= part[:, None] != part[None, :]
            np.fill_diagonal(linked, False)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((linked * size[None, :]).sum(axis=1).astype(np.int64)), pa.array(_roots(linked, ids))], ["rep", "links", "root"])

    return blocks.mapInArrow(verify, f"rep {kind}, links long, root {kind}")


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
) -> DataFrame:
    """Near-duplicate self-join: documents are linked if the Jaccard similarity of their sets of ``n``-word shingles is
    at least ``threshold``. Returns one row per document: doc_id, class_id (the smallest id of those that links
    connect it to) and n_links (with how many other documents it is linked).

    Documents with the same set are one class from the start, so copies cost one row however many there are. Class
    representatives go into ``trees`` sorted prefix tries, whose matched prefixes are shortened as far as ``recall`` at
    the threshold asks (see ``forest_clusters``); candidates with near signatures (four standard deviations below the
    threshold still pass) are put together into clusters. All pairs of a cluster are then verified exactly, in
    blocks of bounded size; blocks return counts and local roots, never pairs. The cost of a cluster of m
    representatives grows with m squared over the block size.

    Defined cases: words are lower-cased and split at white space; documents of one to ``n`` - 1 words have one
    shingle, the whole; null, empty and blank texts have none and stay by themselves (class_id is their id, no
    links), and so do rows whose id is null. Ids must be whole numbers and name one text each; rows repeated count as
    further copies. An empty table gives an empty result; other columns are ignored.
    """
    floor = prefix_depth(trees, MAX_DEPTH, threshold, recall)
    slots = trees * MAX_DEPTH
    least = threshold - 4 * (threshold * (1 - threshold) / slots) ** 0.5
    kind = docs.schema[id_col].dataType.simpleString()
    sketch = materialise(sketches(docs, n, trees, MAX_DEPTH, id_col, text_col), "sketch")
    usable = sketch.filter("k1 is not null and doc_id is not null")
    # A set has one signature, which as a key keeps the aggregate to hashes.
    classes = usable.groupBy("k1", "k2", "signature", "check").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("shingles").alias("shingles"))
    classes = materialise(classes, "classes")
    signed = classes.select("rep", "signature", "check")

    label = lambda t: F.substring("signature", t * (4 * MAX_DEPTH) + 1, F.lit(4 * MAX_DEPTH))
    trees_of = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), label(t).alias("label")))
    nodes = signed.select("rep", F.inline(trees_of)).select("rep", "tree", _prefix(floor).alias("node"))
    shared = materialise(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("node"), "shared")
    tries = materialise(nodes.join(shared, "node").select("rep", "tree"), "members").join(signed, "rep")
    tries = materialise(tries.select("rep", "tree", label(F.col("tree")).alias("label"), "check"), "tries")
    clusters, _ = forest_clusters(tries, least, floor, MAX_DEPTH, slots)

    inside = materialise(clusters.join(classes.select("rep", "size", "shingles"), "rep"), "inside")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES))
    total = materialise(inside.groupBy("cluster").agg(parts.cast("int").alias("parts")), "total")
    texts = docs_of(docs, id_col, text_col).withColumnRenamed("doc_id", "rep").join(inside.join(total, "cluster").hint("merge"), "rep")
    texts = texts.select("cluster", "rep", "parts", "size", word_hashes(F.col("text")).alias("words"))
    blocks = _pairs_of_parts(texts, "cluster", F.pmod(F.xxhash64("rep"), F.col("parts")), F.col("parts"), "rep", "size", "words")
    found = materialise(_verified(blocks, threshold, n, kind), "verified")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))

    grouped = classes.drop("signature", "check").join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    grouped = grouped.select("k1", "k2", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    alone = sketch.filter("k1 is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return usable.select("doc_id", "k1", "k2").join(grouped, ["k1", "k2"]).select("doc_id", "class_id", "n_links").union(alone)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
