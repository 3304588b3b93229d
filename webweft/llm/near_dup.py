"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Every text becomes the set of its GRAM-word shingles (lower case, parted at white space), and its signature: TREES
   paths of DEPTH one-byte minhash labels. Texts of equal sets are one node from here on, known by the set's digest.
2. Forest: in each tree the nodes are sorted by their paths, which is the order of the tree's prefix trie, and read
   once from first to last. A node meets the leader (the first node) of each of its prefixes, from the full DEPTH up
   to the SHALLOWEST one: a linear number of meetings, each with the depth of the longest prefix at which it happens.
3. Signatures (all TREES * DEPTH labels) tell meetings apart: those of at least TIE are ties. `stop_depth` shortens
   the matched prefix, level by level, until the meetings at or over the threshold that happen at that depth reach
   RECALL of what the whole forest is estimated to hold, given the similarities that are found: texts that are nearly
   equal meet at long prefixes, texts at the threshold only at short ones.
4. Where a node is not close (COVERED) to its leader, the triangle inequality does not bound what it may be similar
   to; such nodes of a leader are compared with one another in blocks, and give a spanning forest of their ties, so
   that no pair is lost and no pairs are listed. Ties form candidate clusters.
5. Exact verification: clusters are cut into blocks of about BLOCK nodes or BLOCK_SHINGLES shingles, and every pair of
   blocks is one group, whose shingle sets are intersected by matrix products. It gives each node's number of links,
   and spanning links, never the pairs themselves. Their components are the classes.

Result: a row for each document with class_id (the least doc_id of its class), n_links (other documents of Jaccard
similarity >= threshold) and n_copies (documents with the same shingles, itself included).

Defined cases: texts of fewer than GRAM words are one shingle of all their words; null and empty texts have no shingle
and are copies of one another. Rows are told apart by their text, not by doc_id: rows without doc_id, and rows of one
doc_id with different texts, have the links of their own texts. A class without any doc_id, and a class whose least
doc_id is that of another class too, have a negative number of their own. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_join, slices, small_batches, table, texts_of, written
from .components import components
from .textvec import Words, mix

GRAM, THRESHOLD = 5, 0.8
TREES, DEPTH, SHALLOWEST, RECALL = 32, 8, 5, 0.9999
TIE, COVERED = 0.35, 0.55
BLOCK, BLOCK_SHINGLES = 600, 150_000

_LABELS = TREES * DEPTH
_RANDOM = np.random.default_rng(20240501)
_A = _RANDOM.integers(0, 1 << 31, _LABELS, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, _LABELS, np.uint32)


def chance(similarity: np.ndarray, depth: int) -> np.ndarray:
    """That two sets of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** TREES


def stop_depth(found: list[tuple[int, float, int]], threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix whose meetings have the wanted recall.

    found: (depth, similarity, number) of meetings at or over the threshold, at the longest prefix that they share.
    What the forest missed even at its shallowest prefix is estimated from the chance to meet there.
    """
    whole = sum(n / chance(max(s, threshold), SHALLOWEST) for _, s, n in found)
    depth = DEPTH
    while depth > SHALLOWEST and sum(n for d, _, n in found if d >= depth) < recall * whole:
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(pc.utf8_lower(texts))
    grams, ptr = words.grams(GRAM)
    out = []
    for i in range(len(texts)):
        if ptr[i + 1] > ptr[i]:
            out.append(np.unique(grams[ptr[i] : ptr[i + 1]]))
        else:
            short, h = words.hashes[words.ptr[i] : words.ptr[i + 1]], np.uint64(0)
            for w in short:
                h = mix(np.array([h ^ w], np.uint64))[0]
            out.append(np.array([h] if len(short) else [], np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, TREES * DEPTH) one-byte minhash labels, tree by tree; all ones for an empty set."""
    out = np.full((len(sets), _LABELS), 255, np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        low, starts = (flat >> np.uint64(32)).astype(np.uint32), np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(_LABELS):
            least = np.minimum.reduceat(low * _A[k] + _B[k], starts)
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def paths_of(labels: np.ndarray) -> np.ndarray:
    """(texts, TREES) paths: the labels of a tree as one number, so that numbers sort as paths do."""
    big_endian = np.ascontiguousarray(labels).view(">u8").astype(np.uint64)
    return (big_endian ^ np.uint64(1 << 63)).view(np.int64)


def digest_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, order-free."""
    return tuple(int(mix(shingles ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (0, 0x5DEECE66D))


def row_key(documents: DataFrame) -> list[Column]:
    """What tells rows of different texts apart: id (a null one is the last of all) and a hash of the text."""
    text = F.coalesce(documents["text"], F.lit(""))
    return [F.coalesce(documents["doc_id"], F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("h")]


def _signed(documents: DataFrame) -> DataFrame:
    """For each row doc_id, its key (id, h), the digest of its shingle set (d1, d2), the set's size and its paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(texts_of(part))
                paths = paths_of(signatures(sets))
                digests = np.array([digest_of(s) for s in sets], np.int64).reshape(-1, 2)
                columns = [
                    *(part.column(c) for c in ("doc_id", "id", "h")),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.FixedSizeListArray.from_arrays(pa.array(paths.ravel()), TREES).cast(pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "h", "d1", "d2", "size", "paths"])

    schema = "doc_id long, id long, h long, d1 long, d2 long, size long, paths array<long>"
    return documents.select("doc_id", *row_key(documents), "text").mapInArrow(run, schema)


def read_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings of a run of tree, path and node sorted by these: node, leader and the longest prefix they share.

    What is held from one batch to the next is the last path and the leaders of its prefixes.
    """
    before, leaders = None, np.zeros(DEPTH + 1, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, path, node = (batch.column(c).to_numpy() for c in ("tree", "path", "node"))
        key = path.view(np.uint64) ^ np.uint64(1 << 63)
        out = []
        last = node.copy()
        for depth in range(DEPTH, SHALLOWEST - 1, -1):
            prefix = key >> np.uint64(8 * (DEPTH - depth))
            fresh = np.append(True, (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1]))
            if before is not None:
                fresh[0] = tree[0] != before[0] or prefix[0] != before[1] >> np.uint64(8 * (DEPTH - depth))
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(node)), -1))
            leader = np.where(first >= 0, node[np.maximum(first, 0)], leaders[depth])
            met = (leader != node) & (leader != last)
            out.append((node[met], leader[met], np.full(int(met.sum()), depth, np.int32)))
            last, leaders[depth] = leader, leader[-1]
        before = (tree[-1], key[-1])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "leader", "depth"])


def meetings(nodes: DataFrame) -> DataFrame:
    """node, leader, depth (the longest prefix at which they meet in any tree) and alike, of all trees. nodes: node, paths."""
    members = nodes.select("node", F.posexplode("paths").alias("tree", "path"))
    prefix = F.shiftright("path", 8 * (DEPTH - SHALLOWEST))
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = members.repartition(ranges, "tree", prefix).sortWithinPartitions("tree", "path", "node")
    met = in_order.select("tree", "path", "node").mapInArrow(read_trie, "node long, leader long, depth int")
    met = met.groupBy("node", "leader").agg(F.max("depth").alias("depth"))
    mine, other = nodes.select("node", "paths"), nodes.select(F.col("node").alias("leader"), F.col("paths").alias("other"))
    return _alike(met.join(other, "leader").join(mine, "node"), "paths", "other")


def _labels(paths: pa.Array) -> np.ndarray:
    """The labels of an array of path lists, in an order that is the same for all."""
    return np.ascontiguousarray(paths.flatten().to_numpy()).view(np.uint8).reshape(-1, _LABELS)


def _share(equal: np.ndarray) -> np.ndarray:
    """Similarity from a share of equal labels, less what is equal by chance."""
    return (equal - 1 / 256) / (1 - 1 / 256)


def _alike(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds `alike`, the similarity of two signatures, and drops them."""
    names = [c for c in pairs.columns if c not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alike = _share((_labels(batch.column(a)) == _labels(batch.column(b))).mean(1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(alike)], [*names, "alike"])

    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names) + ", alike double"
    return pairs.mapInArrow(run, schema)


def _block_pairs(rows: DataFrame, key: str, node: str, blocks: Column) -> DataFrame:
    """Rows dealt into every pair (_i <= _j) of the blocks of their key, with _mine: the row's own block."""
    many = rows.groupBy(key).agg(blocks.cast("int").alias("_k"))
    dealt = rows.join(many, key).withColumn("_mine", F.pmod(F.xxhash64(node), F.col("_k")).cast("int"))
    both = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return both.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other")).drop("_k", "_other")


def _far_ties(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the ties among nodes that meet one leader and are not close to it.

    The first node that is not yet covered leads; those close to it are covered by it, since whatever is similar to
    them is tied to it too.
    """
    labels = np.stack([np.asarray(p, np.int64).view(np.uint8) for p in group["paths"]])
    nodes, root, left, out = group["node"].to_numpy(), np.arange(len(group)), np.arange(len(group)), []
    while len(left) > 1:
        alike = _share((labels[left] == labels[left[0]]).mean(1))
        for j in left[1:][alike[1:] >= TIE]:
            if root[j] != root[left[0]]:
                root[root == root[j]] = root[left[0]]
                out.append((nodes[j], nodes[left[0]]))
        left = left[1:][alike[1:] < COVERED]
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def ties(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) between nodes of one candidate cluster. nodes: node, paths."""
    met = written(meetings(nodes), "meetings")
    level = F.round(F.greatest("alike", F.lit(threshold)), 2).alias("level")
    found = met.filter(F.col("alike") >= threshold).groupBy("depth", level).count()  # some rows for each level
    deep = met.filter(F.col("depth") >= stop_depth([tuple(r) for r in found.collect()], threshold))
    far = deep.filter(F.col("alike") < COVERED).select("leader", "node")
    several = far.groupBy("leader").agg(F.count("*").alias("n")).filter("n > 1").select("leader")
    rest = far.join(several, "leader").join(nodes.select("node", "paths"), "node")
    blocks = _block_pairs(rest, "leader", "node", F.ceil(F.count("*") / BLOCK))
    more = blocks.groupBy("leader", "_i", "_j").applyInPandas(_far_ties, "u long, v long")
    near = deep.filter(F.col("alike") >= TIE).select(F.col("node").alias("u"), F.col("leader").alias("v"))
    # Written, so that no task runs two Python workers in a chain.
    return written(near.unionByName(more), "ties")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the intersections of n sets."""
    n, sizes = len(sets), [len(s) for s in sets]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    keep = times[column] > 1
    row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = max(64, 8_000_000 // max(n, 1))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        x = np.zeros((n, min(width, int(column[-1]) + 1 - first)), np.float32)
        x[row[a:b], column[a:b] - first] = 1
        shared += x @ x.T
    return shared


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least number of each one's component."""
    n = len(linked)
    root = np.arange(n, dtype=np.int32)
    while n:
        lower = np.minimum(root, np.where(linked, root[None, :], np.int32(n)).min(1))
        lower = np.minimum(lower, lower[lower])
        if (lower == root).all():
            break
        root = lower
    return root


def verify(threshold: float):
    """The function of a group: rows of one or two blocks with node, n_copies, shingles, _mine, _i, _j."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable").drop_duplicates("node")
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        sizes, shared = np.array([len(s) for s in sets]), _intersections(sets)
        linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-4
        linked &= shared > 0
        np.fill_diagonal(linked, False)
        # In a group of two blocks only pairs across count: pairs inside have a group of their own.
        mine = group["_mine"].to_numpy()
        if group["_i"].iat[0] != group["_j"].iat[0]:
            linked &= mine[:, None] != mine[None, :]
        links = linked.astype(np.float32) @ group["n_copies"].to_numpy().astype(np.float32)
        if len(links) and links.max() > 1e7:  # beyond what 32-bit floats count exactly
            links = linked.astype(np.int64) @ group["n_copies"].to_numpy()
        nodes, hit = group["node"].to_numpy(), links > 0
        return pd.DataFrame({"node": nodes[hit], "root": nodes[_roots(linked)[hit]], "links": links[hit].astype(np.int64)})

    return run


def _sets_of(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Shingle sets of the members (id, h, and columns to keep), once for each node."""
    keep = [c for c in members.columns if c not in ("id", "h")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [s.tobytes() for s in shingle_sets(texts_of(part))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(sets, pa.binary())], [*keep, "shingles"])

    texts = documents.select(*row_key(documents), "text").join(members.hint("merge"), ["id", "h"]).select(*keep, "text")
    schema = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in keep) + ", shingles binary"
    return texts.mapInArrow(run, schema)


def classes_of(documents: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two written tables: for every distinct shingle set d1, d2, its representative row (id, h), class_id, root,
    n_copies and links; and doc_id, id, h, d1, d2 of every row."""
    signed = written(_signed(documents), "signed")
    one = F.min(F.struct("id", "h")).alias("rep")
    nodes = signed.groupBy("d1", "d2").agg(one, F.count("*").alias("n_copies"), F.max("size").alias("size"), F.first("paths").alias("paths"))
    # Numbers are unique whatever attempt of a task writes them; the written table fixes them.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    clusters = components(ties(nodes.filter("size > 0").select("node", "paths"), threshold), "clusters")
    members = nodes.select("node", "rep.id", "rep.h", "n_copies", "size").join(clusters, "node")
    sets = _sets_of(documents, members)
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES))
    found = _block_pairs(written(sets, "sets"), "root", "node", blocks).groupBy("root", "_i", "_j").applyInPandas(verify(threshold), "node long, root long, links long")
    found = written(found, "links")
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = nodes.select("node", "d1", "d2", "rep", "n_copies").join(classes, "node", "left").join(links, "node", "left")
    linked = written(linked.select("d1", "d2", "rep", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "n_copies"), "linked")
    # The first row of each class; of classes that share their first doc_id only the first has it as its number.
    firsts = written(linked.groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("n")), "firsts")
    with_id = firsts.select("root", F.col("first.id").alias("own")).filter(F.col("own") < (1 << 63) - 1)
    own = with_id.groupBy("own").agg(F.min("root").alias("root"))
    named = written(firsts.join(own, "root", "left").select("root", "n", "first", F.coalesce("own", -F.col("root") - 1).alias("class_id")), "named")
    every = keyed_join(linked, named, ["root"], "n")
    return written(every.select("d1", "d2", "rep", "first", "class_id", "n_copies", "links"), "class"), signed.select("doc_id", "id", "h", "d1", "d2")


def join(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document."""
    classes, signed = classes_of(documents, threshold)
    rows = keyed_join(signed, classes, ["d1", "d2"], "n_copies")
    return rows.select("doc_id", "class_id", (F.col("links") + F.col("n_copies") - 1).alias("n_links"), "n_copies")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return join(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the least doc_id (and, of one id, the least hash of its text), once.

    Rows without doc_id are the last of their class; of rows of one id and one text any one stays.
    """
    small_batches(spark)
    classes, _ = classes_of(docs)
    kept = classes.filter(F.col("rep") == F.col("first")).select("rep.id", "rep.h")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *row_key(docs))
    # The join leaves rows of one key together, so that the second step shuffles nothing.
    once = keyed.join(kept.hint("merge"), ["id", "h"]).dropDuplicates(["id", "h"])
    return once.select(*(F.col("row")[c].alias(c) for c in docs.columns))
